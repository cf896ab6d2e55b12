"""Ranked lexical search by a document FP-tree.

Documents are restricted to the terms that some item asks for. In each task the restricted term
vectors, their terms from frequent to rare, are the paths of a trie, so documents with the same
frequent terms share nodes; small branches of one node are put together as a leaf. A node knows
the largest tf of every term and the least m in its subtree: scored as if it were a document it
bounds all documents below. For each item the tree is walked depth first, the best child first;
branches that cannot enter the item's best documents so far are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import _text
from kbspark.llm._store import discard, materialize, small_batches

#: Bytes of words: digits, letters, and all of UTF-8 beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NO_ID = 2**63 - 1


@dataclass(frozen=True)
class Search:
    """``top``: documents an item gets; ``leaf``: most documents of a leaf; ``entries``: terms of one tree; ``terms``: words of the items of one block, which go to all tasks."""

    top: int = 10
    leaf: int = 32
    entries: int = 1 << 21
    terms: int = 1 << 18


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of all words."""
    data = _text.LOWER[data]
    starts, ends, row = _text.spans(WORD[data], offs)
    return _text.hash_spans(data, starts, ends), row


def _lists(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))


def _asked(items: DataFrame) -> DataFrame:
    """``item_id, text_hash, n, terms``: the distinct terms of every item, as hashes; ``n`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(2)):
                h, row = _words(data, offs)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                cut = np.searchsorted(row[new], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(cut), pa.int64()), _lists(cut, h[new].view(np.int64), pa.int64())], ["item_id", "text_hash", "n", "terms"])

    small_batches(items.sparkSession)
    rows = items.select(items["item_id"].cast("long"), F.xxhash64("item_id", "text"), "text")
    return rows.mapInArrow(run, "item_id long, text_hash long, n long, terms array<long>")


def _vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``doc_id, n, ids, tfs``: the words of every document, and its terms of ``terms`` (ascending hashes) with their tf."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(1)):
                h, row = _words(data, offs)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                pairs, tf = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
                cut = np.searchsorted(pairs // len(known), np.arange(hi - lo + 1))
                n = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), _lists(cut, pairs % len(known), pa.int32()), _lists(cut, tf, pa.int32())], ["doc_id", "n", "ids", "tfs"])

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """The documents of every term of the block; each task sends one count a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "df"])

    found = vectors.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("id").to_numpy()] = found.column("df").to_numpy()
    return out


class FPTree:
    """A trie over the restricted vectors of some documents.

    ``cut`` bounds each document's entries in ``rank`` (0: the most frequent term) and ``tf``.
    """

    def __init__(self, ids: np.ndarray, cut: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int, size: int):
        rows = np.repeat(np.arange(len(ids)), np.diff(cut))
        inner = np.lexsort((rank, rows))
        rank, tf = rank[inner], tf[inner]
        keys, at = rank.astype(">u4").tobytes(), (4 * cut).tolist()
        path = [keys[a:b] for a, b in zip(at[:-1], at[1:])]
        order = np.array(sorted(range(len(ids)), key=path.__getitem__), np.int64)
        lengths = np.diff(cut)[order]
        self.cut = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(cut[:-1][order] - self.cut[:-1], lengths) + np.arange(len(rank))
        self.ids, self.m, self.rank, self.tf = ids[order], m[order], rank[take], tf[take]
        self.lo, self.hi, self.parent, self.depth, self.children = [0], [len(ids)], [-1], [0], [[]]
        self._branch(leaf)
        self._bounds(size)

    def _add(self, lo: int, hi: int, parent: int) -> int:
        node = len(self.lo)
        self.lo.append(lo), self.hi.append(hi), self.parent.append(parent), self.depth.append(self.depth[parent] + 1), self.children.append([])
        self.children[parent].append(node)
        return node

    def _branch(self, leaf: int) -> None:
        """Branch nodes of more than ``leaf`` documents by their next term; a shared stretch of path is one node."""
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf:
                continue
            starts, ends = self.cut[lo:hi] + depth, self.cut[lo + 1 : hi + 1]
            last = len(self.rank) - 1
            while True:
                next_ = np.where(starts < ends, self.rank[np.minimum(starts, last)], -1) if last >= 0 else np.full(hi - lo, -1)
                if next_[0] != next_[-1] or next_[0] < 0:
                    break
                starts, depth = starts + 1, depth + 1
            edges = [0, *(np.flatnonzero(np.diff(next_)) + 1).tolist(), hi - lo]
            open_ = 0
            for a, b in zip(edges[:-1], edges[1:]):
                big = b - a > leaf and next_[a] >= 0
                if a > open_ and (big or b - open_ > leaf):
                    self._add(lo + open_, lo + a, node)
                    open_ = a
                if big:
                    todo.append((self._add(lo + a, lo + b, node), depth + 1))
                    open_ = b
                while next_[a] < 0 and b - open_ > leaf:  # equal vectors have no further term to branch by
                    self._add(lo + open_, lo + open_ + leaf, node)
                    open_ += leaf
            if open_ < hi - lo and (open_ or self.children[node]):
                self._add(lo + open_, hi, node)

    def _bounds(self, size: int) -> None:
        """For every node the largest tf of each term below and the least m, listed by term; documents' own entries are leaves' input."""
        nodes = len(self.lo)
        self.least_m = np.array([self.m[a:b].min() if b > a else 0 for a, b in zip(self.lo, self.hi)], np.int64)
        self.least_id = np.array([self.ids[a:b].min() if b > a else 0 for a, b in zip(self.lo, self.hi)], np.int64)
        owner = np.zeros(len(self.ids), np.int64)
        for node in range(nodes):
            if not self.children[node]:
                owner[self.lo[node] : self.hi[node]] = node
        depth, parent = np.array(self.depth), np.array(self.parent)
        key, tf, kept = np.repeat(owner, np.diff(self.cut)) * size + self.rank, self.tf, []
        for level in range(max(self.depth), -1, -1):
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, tf = key[first], np.maximum.reduceat(tf, first) if len(first) else tf
            done = depth[key // size] == level
            kept.append((key[done], tf[done]))
            node = key[done] // size
            key, tf = np.concatenate([key[~done], parent[node] * size + key[done] % size]), np.concatenate([tf[~done], tf[done]])
        key, tf = np.concatenate([k for k, _ in kept]), np.concatenate([t for _, t in kept])
        order = np.argsort(key % size, kind="stable")
        self.node_of, self.most_tf = key[order] // size, tf[order].astype(np.int64)
        self.by_term = np.searchsorted(key[order] % size, np.arange(size + 1))

    def search(self, ranks: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Bring ``best``, a heap of (score, -id), up to date for one item; ``dense`` is a zeroed array of weights."""
        bound = np.zeros(len(self.lo), np.int64)
        for r, w in zip(ranks.tolist(), weights.tolist()):
            a, b = self.by_term[r], self.by_term[r + 1]
            if a < b:
                node = self.node_of[a:b]
                bound[node] += w * gain(self.most_tf[a:b], self.least_m[node])
        dense[ranks] = weights
        todo, reach = [0], bound.tolist()
        while todo:
            node = todo.pop()
            if not reach[node] or len(best) == top and (reach[node], -int(self.least_id[node])) <= best[0]:
                continue
            if below := self.children[node]:
                todo += sorted(below, key=reach.__getitem__)
                continue
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.cut[lo], self.cut[hi]
            w = dense[self.rank[a:b]]
            at = np.flatnonzero(w)
            doc = np.searchsorted(self.cut[lo : hi + 1], at + a, "right") - 1
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, doc, w[at] * gain(self.tf[a:b][at].astype(np.int64), self.m[lo + doc]))
            for i in np.flatnonzero(score).tolist():
                entry = (int(score[i]), -int(self.ids[lo + i]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        dense[ranks] = 0


def _best(vectors: DataFrame, items: list[np.ndarray], order: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int, search: Search) -> DataFrame:
    """``item, doc_id, score``: the best documents of each item among those of each task."""
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    sent = vectors.sparkSession.sparkContext.broadcast((items, rank, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank, weight = sent.value
        own = [(rank[i], weight[i]) for i in items]
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        dense = np.zeros(len(rank), np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def walk() -> None:
            ids, m, lengths, terms, tfs = (np.concatenate(x) for x in zip(*held))
            tree = FPTree(ids, np.concatenate([[0], np.cumsum(lengths)]), rank[terms], tfs, m, search.leaf, len(rank))
            for (r, w), heap in zip(own, best):
                tree.search(r, w, dense, heap, search.top)
            held.clear()

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            m = 10 + 90 * batch.column(1).to_numpy() * n_docs // n_words
            terms, tfs = batch.column(2), batch.column(3)
            held.append((ids, m, terms.value_lengths().to_numpy().astype(np.int64), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            if sum(len(x[3]) for x in held) >= search.entries or sum(len(x[0]) for x in held) >= search.entries >> 4:
                walk()
        if held:
            walk()
        for item, heap in enumerate(best):
            if heap:
                ids = [-i for _, i in heap]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int32()), pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array([s for s, _ in heap], pa.int64())], ["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "ids", "tfs").where(F.size("ids") > 0).mapInArrow(run, "item int, doc_id long, score long")


def _block(docs: DataFrame, asked: list, search: Search) -> DataFrame:
    """The result for the items of one block."""
    spark = docs.sparkSession
    lists = [np.array(r["terms"], np.int64).view(np.uint64) for r in asked]
    known = np.unique(np.concatenate(lists))
    vectors = materialize(_vectors(docs, known), "vectors")
    n_docs, n_words = vectors.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    df = _frequencies(vectors, len(known))
    weight = np.floor(1000 * np.log((2 * (n_docs or 0) + 2) / (2 * df + 1))).astype(np.int64)
    weight[df == 0] = 0
    order = np.argsort(-df, kind="stable")
    items = [np.searchsorted(known, x) for x in lists]
    items = [i[weight[i] > 0] for i in items]
    best = materialize(_best(vectors, items, order, weight, n_docs or 0, n_words or 1, search), "best")
    discard(vectors)
    places = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(places)).where(F.col("rank") <= search.top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``search.top`` best rows of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower
    case, told apart by 64-bit hashes. A term weighs floor(1000 ln((2N+2)/(2df+1))); a document's
    m is 10 + 90nN div L; its score sums weight * (10^9 tf div (1000 tf + 8m)) over the item's
    terms. Only scores above 0 count; equal ones go by doc_id, null ids last.

    Null and empty texts have no terms; rows that repeat an id are ranked one by one, and every
    row of ``items`` is an item of its own. Other columns are not looked at. An empty table on
    either side gives an empty result; texts are read whole. Items are taken in blocks of about
    ``search.terms`` words, each of which reads the documents once.
    """
    spark = docs.sparkSession
    asked = materialize(_asked(items), "asked")
    total = asked.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // search.terms)
    parts = []
    for block in range(blocks):
        rows = asked.where((F.col("n") > 0) & (F.pmod("text_hash", F.lit(blocks)) == block)).orderBy("item_id", "text_hash").collect()  # as many words as a block has
        if rows:
            parts.append(_block(docs, rows, search))
    discard(asked)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
