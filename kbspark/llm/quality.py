"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm import _text
from kbspark.llm._store import small_batches


@dataclass(frozen=True)
class CompressionBands:
    """Length-specific limits on compressed size / size.

    ``limits``: (least bytes, lowest ratio, highest ratio), in ascending order of length; a text
    uses the last band that it reaches. Short texts take up more compressed, by a frame of 13
    bytes; their bands only reject what repeats itself. ``chunk``
    bytes form a chunk; the last one is the final ``chunk`` bytes, so that no tail is left out. A
    text fails if more than ``chunk_share`` of its chunks lie outside ``chunk_limits``; a text of
    less than a chunk is judged whole only.
    """

    limits: tuple[tuple[int, float, float], ...] = ((1, 0.50, 15.0), (32, 0.45, 1.5), (64, 0.40, 1.25), (128, 0.36, 0.98), (256, 0.36, 0.88), (512, 0.34, 0.78), (1024, 0.32, 0.70), (4096, 0.29, 0.64), (16384, 0.26, 0.62), (65536, 0.22, 0.62))
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (0.22, 0.70)
    chunk_share: float = 0.34
    level: int = 3


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks long, bad_chunks long"


def _ratios(text: bytes, zstd, bands: CompressionBands) -> tuple[float, int, int]:
    if not text:
        return 1.0, 0, 0
    ratio = len(zstd.compress(text)) / len(text)
    bad = n = 0
    last = len(text) - bands.chunk
    for at in [*range(0, last, bands.chunk), last] if last >= 0 else []:
        r = len(zstd.compress(text[at : at + bands.chunk])) / bands.chunk
        n += 1
        bad += not bands.chunk_limits[0] <= r <= bands.chunk_limits[1]
    return ratio, n, bad


def _passes(size: int, ratio: float, n: int, bad: int, bands: CompressionBands) -> bool:
    band = None
    for limit in bands.limits:
        if size >= limit[0]:
            band = limit
    if band is not None and not band[1] <= ratio <= band[2]:
        return False
    return bad <= bands.chunk_share * n


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    word = ~_text.SPACE[data]
    starts, ends, row = _text.spans(word, offs)
    n_words = np.bincount(row, minlength=rows)
    # lines: runs of bytes other than \n; blank ones have no word and never count
    l0, l1, lrow = _text.spans(data != 10, offs)
    words_in = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=words_in[1:])
    full = words_in[l1] > words_in[l0]
    l0, l1, lrow = l0[full], l1[full], lrow[full]
    lines = _text.mix(_text.hash_spans(data, l0, l1) + lrow.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(lines, return_index=True)
    n_dup = np.bincount(lrow, minlength=rows) - np.bincount(lrow[at], minlength=rows)
    wins, first = _text.windows(_text.hash_spans(data, starts, ends), row, 8)
    wins = _text.mix(wins + row[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, back, times = np.unique(wins, return_inverse=True, return_counts=True)
    twice = first[times[back] > 1]
    cover = np.zeros(len(starts) + 9, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    repeated = np.cumsum(cover)[: len(starts)] > 0
    return {
        "n_words": n_words,
        "word_chars": _text.per_row(word & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _text.per_row(_SYMBOL[data], offs),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(row[repeated], minlength=rows),
    }


def quality_rules(docs: DataFrame, bands: CompressionBands = CompressionBands()) -> DataFrame:
    """Counts and verdict for every row of ``docs(doc_id, text)``; one narrow pass, no shuffle.

    Null and empty texts have no words and so fail the base rules. Repeated rows and ids are
    judged row by row, null ids are kept, other columns are not looked at, an empty table gives
    an empty result. Long texts are judged whole. Lines and windows of words are told apart by
    64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(1)):
                c = _counts(data, offs)
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                found = [_ratios(data[a:b].tobytes(), zstd, bands) for a, b in zip(offs[:-1], offs[1:])]
                good = [not f and _passes(int(b - a), *r, bands) for f, a, b, r in zip(failed, offs[:-1], offs[1:], found)]
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(good, pa.bool_())]
                cols += [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *c, "base_failed", "kept", "ratio", "chunks", "bad_chunks"])

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, COLUMNS)
