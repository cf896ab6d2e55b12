"""Near-duplicate documents by an exact n-gram Jaccard join over size-banded tiles.

Sets are distinct word n-grams. Sizes are cut into bands so that a linking pair lies in one band
or two neighbouring ones; a tile holds both. In a tile of largest size U two linking sets differ
in at most D(U) n-grams, so if the n-grams are dealt into D(U) + 1 + slack parts by hash, more than
``slack`` parts agree: documents meet only under the hash of an agreeing, non-empty part. A set
with more empty parts than that is dealt again by another hash, until one leaves few enough empty
(two sets are both dealt by the first hash that does so for one of them); after SEEDS hashes such
sets meet under the n-grams of their prefix in hash order. Pairs that meet pass a
bound from 1,024-bit signatures and from such of the tile's own width, then an exact intersection
of sorted arrays.

Only one pair per path is needed for components. Documents of one set are one node; nodes are
held against one hub of each meeting place, in turn another one, until a turn links little or
few pairs are left. At last all pairs that meet and still lie in different components are checked, each pair once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import _text
from kbspark.llm._store import bloom_filters, discard, materialize, small_batches
from kbspark.llm._words import LEAST, doc_key, own_names
from kbspark.llm.graph import components, with_root

SLACK = 2
SEEDS = 4
WORDS64 = 16
#: Pairs that meet for each set of a place, at which all of them are checked.
PAIRS = 8
#: Keys of a shuffle partition that are told apart at once, and most turns for all.
KEYS, TURNS = 1 << 17, 4
#: Bits of a wide signature for each gram of its tile's largest sets.
GRAM_BITS = 8


def bands(largest: int, num: int, den: int) -> list[int]:
    """Lower ends of the size bands up to one beyond ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * den // num + 1)
    return [*out, out[-1] * den // num + 1]


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of each row's distinct word k-grams, ascending in each row."""
    data = _text.LOWER[data]
    starts, ends, row = _text.spans(~_text.SPACE[data], offs)
    h = _text.hash_spans(data, starts, ends)
    grams, at = _text.windows(h, row, k)
    rows = row[at]
    n = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(row, short)
        whole = [_text.mix(np.add.reduce([_text.mix(h[f + j : f + j + 1] + np.uint64(j + 1)) for j in range(m)], axis=0) + np.uint64(m)) for f, m in zip(first, n[short])]
        grams, rows = np.concatenate([grams, *whole]), np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], grams[new]


def _identity(grams: np.ndarray) -> int:
    return int(_text.mix(np.array([_text.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0].astype(np.int64))


def _meetings(grams: np.ndarray, lows: list[int], num: int, den: int) -> np.ndarray:
    """Where a set can meet a set that it links with: a key for each agreeing part in its two tiles."""
    band = int(np.searchsorted(lows, len(grams), "right")) - 1
    out = []
    for tile in (band, band + 1):
        most = 2 * (lows[tile + 1] - 1) * (den - num) // (den + num)
        if not most:
            continue
        slack = SLACK + most // 16
        parts = most + 1 + slack
        for seed in range(SEEDS):
            h = _text.mix(grams + np.uint64(seed)) if seed else grams
            part = ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            content = np.add.reduceat(_text.mix(grams[order] + np.uint64(0x51ED270B)), first)
            out.append(_text.mix(content ^ _text.mix(found.astype(np.uint64) + np.uint64((tile << 32) + (seed << 58)))))
            if parts - len(found) <= slack:
                break
        else:
            prefix = grams[: len(grams) + (-num * len(grams) // den) + 1]
            out.append(_text.mix(prefix ^ _text.mix(np.array([tile + (1 << 60)], np.uint64))))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _documents(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, k2, fp, n, keys``: hash of each row's text, identity and size of its set; keys once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        lows: list[int] = [1]
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(1)):
                rows, grams = sets(data, offs, k)
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                fps, keys = [], []
                for a, b in zip(cut[:-1], cut[1:]):
                    if a == b:
                        fps.append(None), keys.append(None)
                        continue
                    fp = _identity(grams[a:b])
                    fps.append(fp)
                    if fp in seen:
                        keys.append(None)
                        continue
                    seen.add(fp)
                    if lows[-2:][0] <= b - a:
                        lows = bands(int(b - a) * 2, num, den)
                    keys.append(_meetings(grams[a:b], lows, num, den))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(fps, pa.int64()), pa.array(np.diff(cut).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "k2", "fp", "n", "keys"])

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"], F.xxhash64(docs["text"])).mapInArrow(run, "doc_id long, k2 long, fp long, n long, keys array<long>")


def _signature(grams: np.ndarray, words: int) -> list[int]:
    bits = np.zeros(words * 64, np.uint8)
    bits[(grams >> np.uint64(17)) % np.uint64(words * 64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def _contents(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``fp, n, s0.., band, own, next, grams`` from ``rows(fp, text)`` whose text has the set ``fp``; ``own`` and ``next`` are the wide signatures of its two tiles."""
    names = ["fp", "n", *(f"s{i}" for i in range(WORDS64)), "band", "own", "next", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = [1]
        for batch in batches:
            for lo, hi, data, offs in _text.blocks(batch.column(1)):
                rows_, grams = sets(data, offs, k)
                cut = np.searchsorted(rows_, np.arange(hi - lo + 1))
                wanted = batch.column(0).slice(lo, hi - lo).to_pylist()
                out: list[tuple] = []
                for fp, a, b in zip(wanted, cut[:-1], cut[1:]):
                    own = grams[a:b]
                    if a == b or _identity(own) != fp:
                        continue
                    if lows[-2:][0] <= b - a:
                        lows = bands(int(b - a) * 2, num, den)
                    band = int(np.searchsorted(lows, b - a, "right")) - 1
                    wide = [_signature(own, -(-(lows[tile + 1] - 1) * GRAM_BITS // 64)) for tile in (band, band + 1)]
                    out.append((fp, int(b - a), *_signature(own, WORDS64), band, *wide, own.tobytes()))
                kinds = [pa.int64()] * (2 + WORDS64) + [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    small_batches(rows.sparkSession)
    return rows.select("fp", "text").mapInArrow(run, "fp long, n long, " + "".join(f"s{i} long, " for i in range(WORDS64)) + "band int, own array<long>, next array<long>, grams binary")


def _may_link(num: int, den: int) -> Column:
    """Sizes and bit counts of both signatures allow the overlap that a link needs."""
    missing = lambda x, y: sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.s{i}")))) for i in range(1, WORDS64)), F.bit_count(F.col(f"{x}.s0").bitwiseAND(F.bitwise_not(F.col(f"{y}.s0")))))
    need = (F.col("x.n") + F.col("y.n")) * num
    most = F.least(F.col("x.n") - missing("x", "y"), F.col("y.n") - missing("y", "x"))
    # the wide signatures of the tile of both, looked at only if the short ones pass
    tile = F.greatest("x.band", "y.band")
    wide = lambda x: F.when(F.col(f"{x}.band") == tile, F.col(f"{x}.own")).otherwise(F.col(f"{x}.next"))
    lost = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, c: s + c)
    sure = F.when((F.greatest("x.n", "y.n") * num <= F.least("x.n", "y.n") * den) & (most * (num + den) >= need), F.least(F.col("x.n") - lost("x", "y"), F.col("y.n") - lost("y", "x")) * (num + den) >= need)
    return F.coalesce(sure, F.lit(False))


def _linked(pairs: DataFrame, contents: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs(a, b, ..)``, all columns long, whose sets link, by exact intersection of their sorted arrays."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(len(names)), batch.column(len(names) + 1)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(range(len(names))).filter(pa.array(good, pa.bool_()))

    small = contents.select("fp", "grams")
    full = pairs.join(small.toDF("a", "ga"), "a").join(small.toDF("b", "gb"), "b").select(*names, "ga", "gb")
    small_batches(full.sparkSession)
    return full.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _meeting_places(table: DataFrame) -> DataFrame:
    """``key, fp``: the places where two sets or more meet; of places with the same sets one stays, so that those sets meet once.

    Most keys have one set. They are told from the others in turns for parts of the keys, so that
    only one part at a time is in the shuffle; few keys take one turn.
    """
    count = table.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    turns = max(1, min(TURNS, count // (KEYS * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    parts = []
    for turn in range(turns):
        mine = F.filter("keys", lambda k: F.pmod(k, F.lit(turns)) == turn)  # noqa: B023
        keys = table.where("keys is not null").select(F.explode(mine).alias("key"), "fp")
        many = materialize(keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("key"), "places")
        parts.append(materialize(keys.join(many, "key").distinct(), "met"))
        discard(many)
    met = reduce(DataFrame.unionByName, parts)
    lists = met.groupBy("key").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("fp")).alias("members")).where("sets > 1")
    once = materialize(lists.groupBy("sets", "members").agg(F.min("key").alias("key")).select("key"), "places")
    out = materialize(met.join(once, "key"), "met")
    discard(met), discard(once)
    return out


def _apart(own: DataFrame, turn: int) -> DataFrame:
    """``key, fp, comp, sets, hub, hub_comp`` from ``own(key, fp, comp)``: the places with two components or more, each with its hub: the first there in an order of the turn, so that near copies have the same hub in most places."""
    hub = F.min(F.struct(F.xxhash64("fp", F.lit(turn)), "fp", "comp"))
    places = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("sets"), hub.alias("hub")).where("low <> high")
    return materialize(own.join(places.select("key", "sets", F.col("hub.fp").alias("hub"), F.col("hub.comp").alias("hub_comp")), "key"), "apart")


def _rest(apart: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: all pairs of two components that meet and may link, each under the lowest place that both have."""
    own = apart.groupBy("fp").agg(F.collect_set("key").alias("keys"))  # as many as a set has parts
    rows = apart.select("key", "fp", "comp").join(own, "fp").join(marks, "fp").withColumn("lower", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & _may_link(num, den) & ~F.arrays_overlap("x.lower", "y.lower"))
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _groups(docs: DataFrame, num: int, den: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows as of ``_documents``, and ``fp, least, comp``: the least doc_id and the component of every set."""
    keyed = materialize(_documents(docs, k, num, den), "sets")
    met = _meeting_places(keyed)
    table = materialize(keyed.drop("keys"), "rows")
    discard(keyed)
    place = F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("k1"), "k2")
    by_set = table.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(place).alias("at"))
    need = materialize(met.groupBy("fp").agg(F.count("*").alias("places")).join(by_set, "fp").select("fp", "at.k1", "at.k2", "places"), "need")
    # one text a set: neither rows without an id nor texts under one id meet each other
    with bloom_filters(docs.sparkSession):  # keeps texts that meet no other out of the shuffle
        wanted = need.where("places > 0").select("fp", "k1", "k2").join(docs.select(*doc_key(), "text"), ["k1", "k2"])
        contents = materialize(_contents(wanted, k, num, den).dropDuplicates(["fp"]), "contents")
    discard(need)
    marks = contents.drop("grams")

    def check(pairs: DataFrame) -> DataFrame:
        """``a, b, ca, cb`` of the pairs ``x, y, cx, cy`` that link, with their components."""
        first = F.col("x") < F.col("y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("cx")).otherwise(F.col("cy")).alias("ca"), F.when(first, F.col("cy")).otherwise(F.col("cx")).alias("cb")).distinct()
        x, y = marks.alias("x"), marks.alias("y")
        some = pairs.join(x, F.col("a") == F.col("x.fp")).join(y, (F.col("b") == F.col("y.fp")) & _may_link(num, den)).select("a", "b", "ca", "cb")
        return materialize(_linked(some, contents, num, den), "linked")

    links, own, turn = None, met.withColumn("comp", F.col("fp")), 0
    while True:
        apart = _apart(own, turn)
        size, pairs = apart.agg(F.count("*"), F.sum((F.col("sets") - 1) / 2)).first()
        if not size or pairs <= PAIRS * size:
            break
        found = check(apart.where("comp <> hub_comp").select(F.col("fp").alias("x"), F.col("hub").alias("y"), F.col("comp").alias("cx"), F.col("hub_comp").alias("cy")))
        links = found.select("a", "b") if links is None else links.unionByName(found.select("a", "b"))
        if found.count() * 1000 < size:
            break
        # only places that still hold two components go on, and only components that were linked change
        moved = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        own, turn = with_root(apart.select("key", "fp", "comp"), "comp", moved).select("key", "fp", F.coalesce("to", "comp").alias("comp")), turn + 1
    pairs = materialize(_rest(apart, marks, num, den), "pairs")
    found = materialize(_linked(pairs, contents, num, den), "linked")
    labels = components(links.unionByName(found) if links is not None else found)
    discard(met), discard(apart), discard(contents)
    return table, by_set.join(labels, by_set["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))


def near_duplicates(docs: DataFrame, num: int = 90, den: int = 100, k: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Sets are distinct ``k``-grams of words (ASCII lower case, split at ASCII white space); a text
    of fewer words is one gram, one without words has an empty set and links with nothing. Two
    rows link when ``den * intersection >= num * union``; ``component_id`` is the least doc_id
    that a row reaches. Grams are compared by 64-bit hashes. Null ids take part, but are never
    the least if another id is there; repeated rows link with each other; other columns are not
    looked at; an empty table gives an empty result.
    """
    table, own = _groups(docs, num, den, k)
    named = own.groupBy("comp").agg(F.min("least").alias("component"))
    classes = with_root(own, "comp", named).select("fp", "component")
    out = table.select("doc_id", "n", "fp").join(classes, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("fp").isNotNull(), F.col("component")), "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, num: int = 90, den: int = 100, k: int = 3) -> DataFrame:
    """``docs`` with the document of least doc_id of each group of near-duplicates, all its columns unchanged.

    Of rows that repeat that id one stays, the first by text; rows without an id all stay.
    """
    keep, row = own_names(docs, "__keep", "__row")
    named = near_duplicates(docs, num, den, k).where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.where("doc_id is not null").join(named, F.col("doc_id").cast("long") == F.col(keep))
    once = known.withColumn(row, F.row_number().over(Window.partitionBy(keep).orderBy("text"))).where(F.col(row) == 1)
    return once.select(*names).unionByName(docs.where("doc_id is null").select(*names))


def keep_sets(docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """``docs`` with one row of each component of linked sets, all its columns unchanged.

    Rows are told apart by id and text, not by id alone: of a component the row of least doc_id
    stays (null ids last, then by a hash of the text), so copies without an id go and rows that
    repeat an id with unlinked texts stay. Rows without words link with nothing and all stay.
    """
    table, own = _groups(docs, num, den, k)
    one, two, once, row = own_names(docs, "__1", "__2", "__once", "__row")
    first = table.where("fp is not null").join(own.select("fp", "comp"), "fp").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k2")).alias("x"))
    key = lambda c: F.coalesce(F.col(c), F.lit(LEAST)).alias(one)
    keep = first.select(key("x.doc_id"), F.col("x.k2").alias(two), F.lit(True).alias(once))
    bare = table.where("fp is null").select(key("doc_id"), F.col("k2").alias(two), F.lit(False).alias(once)).distinct()
    k1, k2 = doc_key()
    rows = docs.withColumns({one: k1, two: k2}).join(keep.unionByName(bare), [one, two])
    rows = rows.withColumn(row, F.row_number().over(Window.partitionBy(one, two).orderBy(once)))
    return rows.where((F.col(row) == 1) | ~F.col(once)).select(*[F.col(f"`{c}`") for c in docs.columns])
