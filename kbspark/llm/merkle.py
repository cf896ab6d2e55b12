"""A Merkle manifest of a table, proved by multiproofs.

Every row is a leaf. Per source the leaves, in the order of their ids, carry a tree of runs of
``arity`` nodes; the subroots carry another one. Places come from one range sort: a row's place
in its task plus what lies before the task, so no source is ordered in one task. Trees grow by
one aggregation a level, over groups of at most ``arity`` rows.

Proofs are made for blocks of leaves at a time (octopus): a block lists the coordinates of the
nodes that its leaves need and cannot derive, fetches them by one join, derives the interior
nodes that its leaves share, and expands the proof of each leaf from these.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm._store import discard, materialize
from kbspark.llm._words import lower_ascii

#: The tree over the subroots; those of the sources have the places of their sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Shape:
    """``arity``: nodes of a run; ``block``: leaves that are proved together."""

    arity: int = 16
    block: int = 4096


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """The leaf of a row of ``documents``; ``text`` stands in for its text."""
    return F.sha2(F.concat(*[_field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def tampered() -> Column:
    """Rows whose ids' checksum 5 divides; rows without an id are left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def place_leaves(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``doc_id, leaf, other, tree, pos, n, trees, block`` for every row, written once.

    ``leaf`` and ``other`` (of tampered rows, else null) are digests in bytes; ``tree`` is the
    place of the row's source among all (null first, then bytewise), ``pos`` its place among the
    ``n`` leaves of its source, ``trees`` the number of sources, ``block`` its block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(leaf_hash()).alias("leaf"), F.when(tampered(), F.unhex(leaf_hash(lower_ascii("text")))).alias("other"))
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # so that rows repeated often still spread
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    line = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("tie")
    line = materialize(line.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "line")
    discard(rows)
    # from here on one row for each task and source that meet
    runs = line.groupBy("part", "source").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    of_source = Window.partitionBy("source")
    runs = runs.select("*", F.coalesce(F.sum("rows").over(of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(of_source).alias("n"), (F.col("part") == F.min("part").over(of_source)).alias("opens"))
    runs = materialize(runs.withColumn("nth", F.sum(F.col("opens").cast("long")).over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first()))), "runs")
    # and here one row a task
    parts = runs.groupBy("part").agg(F.sum("rows").alias("rows"), F.sum(F.col("opens").cast("long")).alias("opened"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("opened_before"), F.sum("opened").over(everywhere).alias("trees"))
    where = runs.join(parts, "part").select("part", F.col("source").alias("of"), "first", "before", "n", (F.col("opened_before") + F.col("nth") - 1).alias("tree"), "rows_before", "trees")
    near = line["part"].eqNullSafe(where["part"]) & line["source"].eqNullSafe(where["of"])
    placed = line.join(where, near).select("doc_id", "leaf", "other", "tree", (F.col("before") + F.col("row") - F.col("first")).alias("pos"), "n", "trees", F.floor((F.col("rows_before") + F.col("row")) / shape.block).cast("long").alias("block"))
    out = materialize(placed, "placed")
    discard(line), discard(runs)
    return out


def _grow(base: DataFrame, shape: Shape) -> list[DataFrame]:
    """``tree, level, pos, n, hash``, one table a level, from the nodes of level 0; ``n`` counts a level's nodes."""
    levels, most = [base], base.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        up = levels[-1].where("n > 1").groupBy("tree", "level", "n", F.floor(F.col("pos") / shape.arity).cast("long").alias("up")).agg(run.alias("run"))  # at most ``arity`` rows a group
        text = F.lower(F.array_join(F.transform("run", lambda x: F.hex(x["hash"])), ""))
        levels.append(materialize(up.select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("n") / shape.arity).cast("long").alias("n"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash")), "level"))
        most = -(-most // shape.arity)
    return levels


def build(placed: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``tree, level, pos, n, hash`` of all nodes of all trees; a tree's last level has one node."""
    leaves = placed.select("tree", F.lit(0).alias("level"), "pos", "n", F.col("leaf").alias("hash"))
    nodes = reduce(DataFrame.unionByName, _grow(leaves, shape))
    trees = placed.agg(F.max("trees")).first()[0] or 0
    subroots = materialize(nodes.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "hash"), "level")
    return nodes.unionByName(reduce(DataFrame.unionByName, _grow(subroots, shape)))


def _missing(pos: np.ndarray, n: int, arity: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Of one tree the coordinates (level, places) that the known leaves ``pos`` need and cannot derive."""
    out, level, known = [], 0, np.unique(pos)
    while n > 1:
        up = np.unique(known // arity)
        run = (up[:, None] * arity + np.arange(arity)).ravel()
        lack = np.setdiff1d(run[run < n], known, assume_unique=True)
        out.append((level, lack))
        known, n, level = up, -(-n // arity), level + 1
    return out, known


def missing(block: int, tree: np.ndarray, pos: np.ndarray, n: np.ndarray, trees: int, arity: int) -> pd.DataFrame:
    """``block, tree, level, pos``: the least set of nodes that a block of leaves must fetch."""
    rows = []
    order = np.lexsort((pos, tree))
    tree, pos, n = tree[order], pos[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    for a, b in zip(first, [*first[1:], len(tree)]):
        rows += [(int(tree[a]), level, lack) for level, lack in _missing(pos[a:b], int(n[a]), arity)[0]]
    rows += [(TOP, level, lack) for level, lack in _missing(tree[first], trees, arity)[0]]
    size = [len(lack) for *_, lack in rows]
    return pd.DataFrame({"block": block, "tree": np.repeat([t for t, *_ in rows], size).astype("int64"), "level": np.repeat([v for _, v, _ in rows], size).astype("int32"), "pos": np.concatenate([lack for *_, lack in rows] or [np.zeros(0, np.int64)]).astype("int64")})


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Block:
    """The nodes that a block knows: its leaves, what it has fetched, and what follows from these."""

    def __init__(self, nodes: dict[tuple[int, int, int], str], sizes: dict[int, int], arity: int):
        self.nodes, self.sizes, self.arity = nodes, sizes, arity
        self.joined: dict[tuple[int, int, int], str] = {}
        self.rest: dict[tuple[int, int, int], str] = {}

    def run(self, tree: int, level: int, up: int) -> str:
        """The digests of a run, left to right, as one text."""
        key = (tree, level, up)
        if key not in self.joined:
            n = self.count(tree, level)
            self.joined[key] = "".join(self.node(tree, level, p) for p in range(up * self.arity, min((up + 1) * self.arity, n)))
        return self.joined[key]

    def count(self, tree: int, level: int) -> int:
        n = self.sizes[tree]
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def node(self, tree: int, level: int, pos: int) -> str:
        key = (tree, level, pos)
        if key not in self.nodes:
            self.nodes[key] = self.node(pos, *self.last(pos)) if tree == TOP and not level else _sha(self.run(tree, level - 1, pos))
        return self.nodes[key]

    def last(self, tree: int) -> tuple[int, int]:
        """Level and place of a tree's root."""
        n, level = self.sizes[tree], 0
        while n > 1:
            n, level = -(-n // self.arity), level + 1
        return level, 0

    def above(self, tree: int, level: int, pos: int) -> tuple[int, int, int] | None:
        """The node that takes this one in; None for the root of all."""
        if (level, pos) != self.last(tree):
            return tree, level + 1, pos // self.arity
        return None if tree == TOP else self.above(TOP, 0, tree) if self.sizes[TOP] > 1 else None

    def at(self, tree: int, level: int, pos: int) -> tuple[int, int, int]:
        """The coordinates under which a node stands in a run: a subroot is a leaf of the top tree."""
        return (TOP, 0, tree) if tree != TOP and (level, pos) == self.last(tree) else (tree, level, pos)

    def siblings(self, tree: int, level: int, pos: int) -> tuple[str, str]:
        """What stands left and right of a node in its run."""
        run, i = self.run(tree, level, pos // self.arity), 64 * (pos % self.arity)
        return run[:i], run[i + 64 :]

    def proof(self, tree: int, level: int, pos: int) -> str:
        """The siblings from a node up to the root."""
        up = self.above(tree, level, pos)
        if up is None:
            return ""
        key = self.at(tree, level, pos)
        if level and key in self.rest:
            return self.rest[key]
        out = "".join(self.siblings(*key)) + self.proof(*up)
        if level:
            self.rest[key] = out
        return out

    def fold(self, tree: int, level: int, pos: int, digest: str) -> str:
        """The root that follows from a digest at a place and its siblings."""
        while (up := self.above(tree, level, pos)) is not None:
            left, right = self.siblings(*self.at(tree, level, pos))
            digest = _sha(f"{left}{digest}{right}")
            tree, level, pos = up
        return digest


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(placed: DataFrame, nodes: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The columns of ``PROOF`` for every row of ``placed``, which may be any part of the leaves that ``nodes`` were built from."""
    arity = shape.arity

    def lacking(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return missing(key[0], rows["tree"].to_numpy(), rows["pos"].to_numpy(), rows["n"].to_numpy(), int(rows["trees"].iloc[0]), arity)

    def expand(key: tuple, rows: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        known = {(t, 0, p): h.hex() for t, p, h in zip(rows["tree"].tolist(), rows["pos"].tolist(), rows["leaf"])}
        known |= {(t, v, p): h.hex() for t, v, p, h in zip(fetched["tree"].tolist(), fetched["level"].tolist(), fetched["pos"].tolist(), fetched["hash"])}
        sizes = dict(zip(rows["tree"].tolist(), rows["n"].tolist())) | ({TOP: int(rows["trees"].iloc[0])} if len(rows) else {})
        block, out = _Block(known, sizes, arity), []
        root = block.node(TOP, *block.last(TOP)) if len(rows) else ""
        for doc, leaf, other, tree, pos in zip(rows["doc_id"], rows["leaf"], rows["other"], rows["tree"].tolist(), rows["pos"].tolist()):
            folded = root if other is None else block.fold(tree, 0, pos, other.hex())
            out.append((doc, leaf.hex(), block.node(tree, *block.last(tree)), root, _sha(block.proof(tree, 0, pos)), folded, folded == root))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in PROOF.split(", ")]).astype({"doc_id": "Int64"})
        table.loc[rows["bare"].to_numpy(bool), "doc_id"] = pd.NA
        return table

    need = placed.select("block", "tree", "pos", "n", "trees").groupBy("block").applyInPandas(lacking, "block long, tree long, level int, pos long")
    fetched = need.join(nodes.select("tree", "level", "pos", "hash"), ["tree", "level", "pos"]).groupBy("block")
    rows = placed.withColumns({"bare": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))}).groupBy("block")  # a null would make all ids of a frame floating
    return rows.cogroup(fetched).applyInPandas(expand, PROOF)


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The columns of ``PROOF`` for every row of ``docs``.

    A leaf is the SHA-256 of ``doc_id, source, lang, n_chars, text``, each ``-`` if null, else its
    length in bytes, ``:`` and its value. Where 5 divides the CRC-32 of the id, the leaf of the
    text with A-Z in lower case is folded up in place of the row's own, with the siblings of the
    untampered tree. Null ids come first in their source and are never tampered with; rows that
    repeat an id go by their leaf, equal rows are leaves of their own. Null sources are one source,
    the first. Other columns are not looked at. An empty table has no root and gives no rows.
    """
    placed = place_leaves(docs, shape)
    return prove(placed, materialize(build(placed, shape), "nodes"), shape)
