"""Cross-entropy difference of two matched n-gram language models.

The target model is counted on documents given as target, the background model on all documents.
Both are bigram models over one vocabulary, the words of all documents, and both use the same
interpolation of pair, word and uniform probabilities, so their losses can be subtracted token by
token. Words and (before, word) pairs are counted one by one, told apart by 63-bit hashes, in a
table that grows with the corpus. The counts of the most frequent grams go to the tasks; for the
others documents ask the table in blocks of about a megabyte, each gram once a block. A gram that
occurs once in all documents is left out of the table, as its only document knows it.

``train`` and ``score`` are a fixed-size variant for small tables: words and pairs share ``2**bits``
hashed entries, and so their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kbspark.llm import _text
from kbspark.llm._store import discard, materialize, small_batches

_START = np.uint64(0x2545F4914F6CDD1D)


def _pairs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the words and 64-bit hashes of the words, of those before (or of the start) and of the pairs."""
    low = _text.LOWER[data]
    starts, ends, row = _text.spans(~_text.SPACE[low], offs)
    h = _text.hash_spans(low, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.flatnonzero(np.diff(row, prepend=-1))] = _START
    return row, h, before, _text.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _tokens(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the words, their entries, those of the words before (or of the start) and of the pairs."""
    row, h, before, pair = _pairs(data, offs)
    shift = np.uint64(64 - bits)
    return row, (h >> shift).astype(np.int64), (_text.mix(before) >> shift).astype(np.int64), (pair >> shift).astype(np.int64)


@dataclass(frozen=True)
class NgramModel:
    """Counts of words, of words as contexts and of pairs, each an array of ``2**bits`` numbers."""

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    weights: tuple[float, float] = (0.6, 0.38)

    def loss(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Negative natural logarithm of each token's probability."""
        two, one = self.weights
        p = two * self.pair[pair] / np.maximum(self.context[context], 1) + one * self.word[word] / max(float(self.word.sum()), 1.0)
        return -np.log(np.minimum(p, 1.0) + (1 - two - one) / len(self.word))


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``target, text, doc_id`` of every row."""
    marks = target_ids.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct().withColumn("target", F.lit(True))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(marks, F.col("doc_id") == F.col("__id"), "left")
    return rows.select(F.coalesce("target", F.lit(False)).alias("target"), "text", "doc_id")


def train(docs: DataFrame, target_ids: DataFrame, bits: int = 20) -> tuple[NgramModel, NgramModel]:
    """Target and background models from ``docs(doc_id, text)``; ``target_ids(doc_id)`` are the target documents.

    Every word of every document is counted; the executors add up the counts, and only the two
    tables (3 * 2**bits numbers each, a documented parameter) come to the driver.
    """
    rows = _marked(docs, target_ids)
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * size), np.int64)
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for lo, _, data, offs in _text.blocks(batch.column(1)):
                row, word, context, pair = _tokens(data, offs, bits)
                mine = target[lo + row]
                for kind, cells in enumerate((word, context, pair)):
                    total[0, kind * size : (kind + 1) * size] += np.bincount(cells[mine], minlength=size)
                    total[1, kind * size : (kind + 1) * size] += np.bincount(cells, minlength=size)
        at = np.flatnonzero(total[1])
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[0, part]), pa.array(total[1, part])], ["cell", "t", "b"])

    small_batches(rows.sparkSession)
    cells = rows.mapInArrow(count, "cell int, t long, b long").groupBy("cell").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
    at = cells.column("cell").to_numpy()
    out = []
    for name in ("t", "b"):
        full = np.zeros(3 * size, np.float32)
        full[at] = cells.column(name).to_numpy()
        out.append(NgramModel(*full.reshape(3, size)))
    return out[0], out[1]


def score(docs: DataFrame, target: NgramModel, background: NgramModel) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` for every row of ``docs(doc_id, text)``.

    Losses are means per token in nats, ``score`` is their difference, target minus background:
    the lower, the more like the target. A text without words has no tokens and null losses.
    Rows are scored one by one, so repeated rows, null ids and other columns make no difference;
    long texts are read whole; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((target, background))
    bits = len(target.word).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(1)):
                row, word, context, pair = _tokens(data, offs, bits)
                n = np.bincount(row, minlength=hi - lo)
                with np.errstate(invalid="ignore", divide="ignore"):
                    loss = [np.bincount(row, m.loss(word, context, pair), hi - lo) / n for m in models]
                none = n == 0
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *(pa.array(x, pa.float64(), mask=none) for x in (loss[0], loss[1], loss[0] - loss[1]))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row numbers of the words, and as grams (a pair is odd, all others are even) the words, those before and the pairs; last, which words end their text."""
    row, h, before, pair = _pairs(data, offs)
    even = ~np.uint64(1)
    return row, (h & even).astype(np.int64), (before & even).astype(np.int64), (pair | np.uint64(1)).astype(np.int64), np.diff(row, append=-1) != 0


#: Grams that count the texts with a word and all words.
_TEXTS, _ALL = int((_START & ~np.uint64(1)).astype(np.int64)), 0x5851F42D4C957F2C
_COUNTS = ("t", "b", "te", "be")


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Each gram once, ascending, with its counts added up."""
    gram, *counts = map(np.concatenate, zip(*held))
    order = np.argsort(gram, kind="stable" if len(held) > 1 else None)  # a stable sort is fast on ascending runs alone
    first = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) != 0]))
    return gram[order[first]], *(np.add.reduceat(c[order], first) for c in counts)


def _first(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each gram once, ascending, and where it stands first."""
    order = np.argsort(gram)
    gram = gram[order]
    new = np.flatnonzero(np.diff(gram, prepend=~gram[:1]) != 0)
    return gram[new], np.minimum.reduceat(order, new) if len(new) else order


def _turn(gram: np.ndarray, turns: int) -> np.ndarray:
    """The turn in which each gram is counted and asked for."""
    return (gram >> 32) % turns


def _gram_counts(rows: DataFrame, turn: int, turns: int) -> DataFrame:
    """``gram, t, b, te, be``: how often each gram of a turn occurs in target and background of ``rows(target, text)``, and how often it ends a text there.

    Only grams of two occurrences or more are in the table, and the two that count texts and words:
    whoever meets a gram that is not in it has its only occurrence before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in cols], ["gram", *_COUNTS])

        held, size = [], 0
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, data, offs in _text.blocks(batch.column(1)):
                row, word, _, pair, last = _grams(data, offs)
                if not len(pair):
                    continue
                # two counts in a number: that in the target below, that in all documents above
                uses = target[lo + row] + (1 << 32)
                none, ends = np.zeros(len(row), np.int64), uses * last
                every = (np.full(1, _ALL), uses.sum(keepdims=True), none[:1])
                texts = (np.full(last.sum(), _TEXTS), uses[last], none[last])
                gram, *both = map(np.concatenate, zip((pair, uses, none), (word, uses, ends), texts, every))
                mine = _turn(gram, turns) == turn
                if not mine.any():
                    continue
                gram, *both = _merged([(gram[mine], *(c[mine] for c in both))])
                held.append((gram, *(x for c in both for x in (c & 0xFFFFFFFF, c >> 32))))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(_merged(held))

    small_batches(rows.sparkSession)
    found = rows.mapInArrow(run, "gram long, " + ", ".join(f"{c} long" for c in _COUNTS))
    # each task gives a gram about once, so sums before the shuffle would be in vain
    found = found.repartition("gram").groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return found.where((F.col("b") > 1) | F.col("gram").isin(_TEXTS, _ALL))


def _frequent(counts: DataFrame, most: int) -> tuple[int, list[np.ndarray]]:
    """The least count of which at most ``most`` grams have as much or more, and these grams, ascending, with their counts."""
    log = F.floor(F.log2("b") * 8)
    seen, least = 0, 2**62
    for r in counts.groupBy(log.alias("step")).agg(F.count("*").alias("n"), F.min("b").alias("low")).orderBy(F.desc("step")).collect():
        seen += r["n"]
        if seen > most:
            break
        least = r["low"]
    sent = counts.where(F.col("b") >= least).toArrow()
    cols = [sent.column(c).to_numpy() for c in ("gram", *_COUNTS)]
    order = np.argsort(cols[0])
    return least, [c[order] for c in cols]


def _places(known: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each gram stands among the ascending ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(gram), np.int64), np.zeros(len(gram), bool)
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return at, known[at] == gram


def _blocks(rows: DataFrame) -> DataFrame:
    """``block, no, doc_id, target, text``: rows in blocks of about a megabyte of text, numbered in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, _, _ in _text.blocks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, number)), pa.array(np.arange(hi - lo, dtype=np.int32)), *(c.slice(lo, hi - lo) for c in batch.columns)], ["block", "no", "doc_id", "target", "text"])
                number += 1

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "target", "text").mapInArrow(run, "block long, no int, doc_id long, target boolean, text string")


def _asked(blocks: DataFrame, sent: Broadcast, turn: int, turns: int) -> DataFrame:
    """``gram, block, no, at``: the grams of a turn that are not among those sent, each once a block: row and twice the word's place there, one more for a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0]
        for batch in batches:
            block, no = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for begin, end in zip(edges[:-1], edges[1:]):
                for lo, _, data, offs in _text.blocks(batch.column(2).slice(begin, end - begin)):
                    row, word, _, pair, _ = _grams(data, offs)
                    gram = np.concatenate([word, pair])
                    mine = np.flatnonzero(_turn(gram, turns) == turn)
                    gram, first = _first(gram[mine])
                    new = ~_places(known, gram)[1]
                    order = np.argsort(first[new])  # neighbours in the text stay neighbours: this compresses
                    gram, first = gram[new][order], mine[first[new][order]]
                    kind = first >= len(word)
                    token = first - kind * len(word)
                    at = 2 * (token - np.searchsorted(row, row[token])) + kind
                    cols = gram, np.full(len(gram), block[begin]), no[begin + lo + row[token]], at.astype(np.int32)
                    for i in range(0, len(gram), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in cols], ["gram", "block", "no", "at"])

    return blocks.select("block", "no", "text").mapInArrow(run, "gram long, block long, no int, at int")


_PACKED = ("no", "at", *_COUNTS)


def _packed(found: DataFrame) -> DataFrame:
    """``block, rows`` and each column of ``_PACKED`` as bytes: neighbouring answers of a block as arrays of the narrowest whole numbers that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, *cols = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            spans = [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]
            narrow = [pa.array([c[a:b].astype(np.min_scalar_type(c[a:b].max())).tobytes() for a, b in spans], pa.binary()) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array([block[a] for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int32()), *narrow], ["block", "rows", *_PACKED])

    return found.select("block", *_PACKED).mapInArrow(run, "block long, rows int, " + ", ".join(f"{c} binary" for c in _PACKED))


def _unpacked(packed: pa.Table) -> dict[str, np.ndarray]:
    """The columns of ``_PACKED`` from the rows of one block."""
    rows = packed.column("rows").to_pylist()
    read = lambda c: [np.frombuffer(x, f"u{len(x) // n}").astype(np.int64) for x, n in zip(packed.column(c).to_pylist(), rows)]
    return {c: np.concatenate([np.zeros(0, np.int64), *read(c)]) for c in _PACKED}


def exact_difference(docs: DataFrame, target_ids: DataFrame, weights: tuple[float, float] = (0.6, 0.38), frequent: int = 1_000_000, turns: int = 2) -> DataFrame:
    """The columns of ``score`` for every row, from counts of all words and pairs.

    ``frequent`` is how many of the most frequent grams have their counts sent to the tasks, and
    in ``turns`` parts grams are counted and asked for, so that only one part at a time is in the
    shuffle; neither makes a difference to the result.
    """
    spark = docs.sparkSession
    blocks = materialize(_blocks(_marked(docs, target_ids)), "lm-blocks")  # numbers of blocks are those of the written table
    special = F.col("gram").isin(_TEXTS, _ALL)
    whole: dict[int, Row] = {}
    size, tables, found = 0, [], []
    for turn in range(turns):
        counts = materialize(_gram_counts(blocks.select("target", "text"), turn, turns), "lm-counts")
        whole.update({r["gram"]: r for r in counts.where(special).collect()})
        words = counts.where((F.col("gram").bitwiseAND(F.lit(1)) == 0) & ~special).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
        size += words["n"] - (words["b"] or 0)
        least, table = _frequent(counts, frequent // turns)
        tables.append(spark.sparkContext.broadcast(table))
        asked = _asked(blocks, tables[-1], turn, turns).join(counts.where(F.col("b") < least), "gram")
        found.append(materialize(_packed(asked.sortWithinPartitions("block", "no", "at")), "lm-found"))
        discard(counts)
    texts, total = ({kind: int(whole[gram][kind]) if whole else 0 for kind in "tb"} for gram in (_TEXTS, _ALL))
    size += total["b"]  # a word that is in no table occurs once

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by("no")
        target = rows.column("target").to_numpy().astype(np.int64)
        [(_, height, data, offs)] = _text.blocks(rows.column("text").combine_chunks(), 1 << 62)
        row, word, before, pair, last = _grams(data, offs)
        t, end = target[row], last.astype(np.int64)
        answers = _unpacked(found)
        at = answers["at"]
        token = np.searchsorted(row, answers["no"]) + at // 2
        gram, first = _first(np.where(at % 2, pair[token], word[token]))
        held = [gram, *(answers[c][first] for c in _COUNTS)]

        def counted(gram: np.ndarray) -> list[np.ndarray]:
            """Counts of each gram; one that is in no table occurs here only."""
            out = [t.copy(), np.ones(len(gram), np.int64), t * end, end.copy()]
            order = np.argsort(gram)  # ascending grams are found faster
            gram = gram[order]
            turn = _turn(gram, turns)
            for asked, (known, *cols) in ((turn >= 0, held), *((turn == i, x.value) for i, x in enumerate(tables))):
                asked = np.flatnonzero(asked)
                at, there = _places(known, gram[asked])
                at, place = at[there], order[asked[there]]
                for mine, col in zip(out, cols):
                    mine[place] = col[at]
            return out

        of_pair, of_word = counted(pair), counted(word)
        n = np.bincount(row, minlength=height)
        loss = []
        for i, kind in enumerate("tb"):
            # a word stands before another as often as it occurs without ending its text
            context = np.roll(of_word[i] - of_word[i + 2], 1)
            context[before == _TEXTS] = texts[kind]
            p = weights[0] * of_pair[i] / np.maximum(context, 1) + weights[1] * of_word[i] / max(total[kind], 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                loss.append(np.bincount(row, -np.log(p + (1 - sum(weights)) / max(size, 1)), height) / n)
        cols = [rows.column("doc_id").combine_chunks(), pa.array(n.astype(np.int64)), *(pa.array(x, pa.float64(), mask=n == 0) for x in (loss[0], loss[1], loss[0] - loss[1]))]
        return pa.Table.from_arrays(cols, ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    every = reduce(DataFrame.unionByName, found)
    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(judge, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, bits: int | None = None) -> DataFrame:
    """Count both models and score every document; with ``bits``, by the fixed-size variant."""
    return exact_difference(docs, target_ids) if bits is None else score(docs, *train(docs, target_ids, bits))
