"""Language identification by mixture inference.

Each language has a table of byte-trigram likelihoods, learnt from labelled rows. A document is
a mixture of languages; expectation-maximisation estimates the proportions, and languages leave
the set while the penalised likelihood (Bayesian information criterion) gains by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm import _text
from kbspark.llm._store import small_batches

BITS = 16
UNKNOWN = "und"

#: ASCII letters in lower case and all bytes of other letters; the rest is a blank.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codes of the trigrams whose middle byte is not blank; rows are padded with blanks."""
    rows = len(offs) - 1
    at = offs[:-1] + 2 * np.arange(rows)
    padded = np.full(len(data) + 2 * rows, 32, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offs))
    padded[np.arange(len(data)) + 2 * row + 1] = _LETTERS[data]
    x = padded.astype(np.uint32)
    code = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) if len(x) > 2 else np.zeros(0, np.uint32)
    middle = np.flatnonzero(x[1:-1] != 32) if len(x) > 2 else np.zeros(0, np.int64)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    return np.searchsorted(at, middle + 1, "right") - 1, code[middle].astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` in ascending order and ``log_p[2**BITS, len(langs)]``."""

    langs: tuple[str, ...]
    log_p: np.ndarray


def train(docs: DataFrame, max_docs_per_lang: int = 2000, smoothing: float = 0.1, max_langs: int = 400) -> LanguageModel:
    """Learn from ``docs(text, lang, doc_id)`` with a text and a lang that are not held out.

    At most about ``max_docs_per_lang`` whole texts of each language are used: the documented
    bound of the labelled sample. They are those with the least hash of the id, by one threshold
    for each language, so no language is gathered in one task. Counts are added up by Spark and
    only the table of likelihoods (languages x 65,536 numbers) comes to the driver.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    langs = tuple(sorted(r["lang"] for r in sizes))
    if not langs:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, max_docs_per_lang / r["count"])))])
    place = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(unit < share[F.col("lang")]).select(place[F.col("lang")].alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) << BITS, np.int64)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, data, offs in _text.blocks(batch.column(1)):
                row, code = _grams(data, offs)
                total += np.bincount(k[lo + row] << BITS | code, minlength=len(total))
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    small_batches(sample.sparkSession)
    cells = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) << BITS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(len(langs), 1 << BITS) + smoothing
    return LanguageModel(langs, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))


def _fit(p: np.ndarray, n: np.ndarray, row: np.ndarray, first: np.ndarray, w: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions ``w`` [row, language] of rows made of gram likelihoods ``p`` seen ``n`` times; also the log-likelihood."""
    for _ in range(steps):
        joint = p * w[row]
        scale = n / joint.sum(1)
        w = np.add.reduceat(joint * scale[:, None], first)
        w /= w.sum(1, keepdims=True)
    return w, np.add.reduceat(n * np.log((p * w[row]).sum(1)), first)


def mixtures(log_p: np.ndarray, row: np.ndarray, code: np.ndarray, rows: int, steps: int = 8, refit: int = 3) -> np.ndarray:
    """Proportions of the selected languages for each row; zeros for rows without grams."""
    k = log_p.shape[1]
    out = np.zeros((rows, k), np.float32)
    key, n = np.unique(row << BITS | code, return_counts=True)
    if not len(key) or not k:
        return out
    n = n.astype(np.float32)
    row, lp = key >> BITS, log_p[key & ((1 << BITS) - 1)]
    p = np.exp(lp - lp.max(1, keepdims=True))
    there, first, row = np.unique(row, return_index=True, return_inverse=True)
    total = np.add.reduceat(n, first)
    w, fit = _fit(p, n, row, first, np.full((len(there), k), 1 / k, np.float32), steps)
    active = np.ones((len(there), k), bool)
    open_ = np.arange(len(there))
    for _ in range(k - 1):
        least = np.where(active[open_], w[open_], np.inf).argmin(1)
        trial = active[open_].copy()
        trial[np.arange(len(open_)), least] = False
        start = np.where(trial, w[open_] + 1e-6, 0)
        start /= start.sum(1, keepdims=True)
        mine = np.full(len(there), -1)
        mine[open_] = np.arange(len(open_))
        use = mine[row] >= 0
        sub = mine[row[use]]
        w2, fit2 = _fit(p[use], n[use], sub, np.searchsorted(sub, np.arange(len(open_))), start.astype(np.float32), refit)
        better = fit2 + 0.5 * np.log(total[open_]) >= fit[open_]
        open_, w2, fit2, trial = open_[better], w2[better], fit2[better], trial[better]
        w[open_], fit[open_], active[open_] = w2, fit2, trial
        if not len(open_):
            break
    out[there] = w
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred string, score double, mixture map<string,double>`` for every row of ``docs(doc_id, text)``.

    ``lang_pred`` is the language of the largest proportion (ties: the first by name), ``score``
    that proportion. A null text, one without a letter, or a model without languages gives
    ``und`` and 0. Rows are judged one by one, so repeated rows, null ids and other columns make
    no difference; long texts are read whole; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = sent.value
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(1), max(1 << 16, (1 << 20) // max(4, len(langs)))):
                row, code = _grams(data, offs)
                w = mixtures(log_p, row, code, hi - lo)
                ascii_letter = _text.per_row((_LETTERS[data] != 32) & (data < 128), offs) > 0
                pred, score, mix = [], [], []
                for i in range(hi - lo):
                    letter = ascii_letter[i] or any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
                    if not letter or not len(langs) or not w[i].any():
                        pred.append(UNKNOWN), score.append(0.0), mix.append([])
                    else:
                        best = int(w[i].argmax())
                        pred.append(langs[best]), score.append(min(1.0, float(w[i, best])))
                        mix.append([(langs[j], float(w[i, j])) for j in np.flatnonzero(w[i])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.4) -> DataFrame:
    """Rows of ``docs`` with a language of at least ``least`` of the mixture, all their columns unchanged; narrow, row by row.

    The verdict is computed beside the row, so null or repeated ids need no join.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = sent.value
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offs in _text.blocks(batch.column(at), max(1 << 16, (1 << 20) // max(4, len(langs)))):
                row, code = _grams(data, offs)
                if len(langs):
                    good[lo:hi] = mixtures(log_p, row, code, hi - lo).max(1) >= least
                for i in np.flatnonzero(good[lo:hi]):
                    text = data[offs[i] : offs[i + 1]]
                    if not ((_LETTERS[text] != 32) & (text < 128)).any():
                        good[lo + i] = any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))
            yield batch.filter(pa.array(good))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
