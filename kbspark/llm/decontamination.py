"""Benchmark decontamination by a broadcast hash set of n-grams, with DataFrame functions only.

Every benchmark window of ``n`` words has one anchor: that of its short word runs with the least
hash. The runs of all documents meet the set of anchors, which goes to every task while it takes
at most ``broadcast_bytes``; beyond it the runs are shuffled. Around each place found the window's
words are compared one by one. Runs have three words, in shorter items as many as the item has, so
that one short item makes no others common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm._store import bloom_filters, materialize
from kbspark.llm._words import GAP, doc_key, own_names, words

RUN = 3
#: What an anchor takes in a broadcast hash table, at most.
_ANCHOR_BYTES = 64


def _run_hash(array: str, at: Column, run: int) -> Column:
    return F.xxhash64(F.lit(run), *[F.get(array, at + j) for j in range(run)])


def _run_hashes(array: str, run: int) -> Column:
    """Hashes of all runs of a word array, in order; null if it is too short."""
    return F.when(F.size(array) >= run, F.transform(F.sequence(F.lit(0), F.size(array) - run), lambda i: _run_hash(array, i, run)))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``item, run, size, off, anchor, gram`` for each window of ``benchmark(item_id, text)``.

    ``run`` is the length of its anchor in words, ``off`` the anchor's place in the window. An
    item of fewer than ``n`` words, but not none, is one window.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words("text").alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    items = items.withColumn("len", F.size("words")).withColumn("size", F.least(F.lit(n), "len")).withColumn("run", F.least(F.lit(min(RUN, n)), "len"))
    runs = F.coalesce(*[F.when(F.col("run") == r, _run_hashes("words", r)) for r in range(1, RUN + 1)])
    wins = items.withColumn("runs", runs).select("item", "run", "size", "words", "runs", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))).alias("at"))
    wins = wins.withColumn("inside", F.slice("runs", F.col("at") + 1, F.col("size") - F.col("run") + 1))
    return wins.select("item", "run", "size", (F.array_position("inside", F.array_min("inside")) - 1).cast("int").alias("off"), F.array_min("inside").alias("anchor"), F.slice("words", F.col("at") + 1, F.col("size")).alias("gram")).distinct()


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """The verified hits ``k1, k2, item, start, size`` of all windows in all documents."""
    wins = materialize(benchmark_windows(benchmark, n), "windows")
    anchors = wins.select("anchor").distinct()
    small = anchors.count() * _ANCHOR_BYTES <= broadcast_bytes
    anchors = F.broadcast(anchors) if small else anchors.hint("merge")
    found = docs.sparkSession.createDataFrame([], "k1 long, k2 long, p int")
    runs = sorted(r["run"] for r in wins.select("run").distinct().collect())  # three at most
    for run in runs:
        rows = docs.select(*doc_key(), words("text").alias("words")).select("k1", "k2", F.posexplode(_run_hashes("words", run)).alias("p", "anchor"))
        found = found.unionByName(rows.join(anchors, "anchor", "left_semi").select("k1", "k2", "p"))
    found = materialize(found.groupBy("k1", "k2").agg(F.collect_set("p").alias("found")), "places")
    around = lambda p: F.struct(p.alias("p"), F.greatest(p - n + 1, F.lit(0)).alias("lo"), F.slice("words", F.greatest(p - n + 1, F.lit(0)) + 1, F.lit(2 * n)).alias("near"))
    with bloom_filters(docs.sparkSession):  # keeps the texts without a place out of the shuffle
        near = docs.select(*doc_key(), "text").join(found.where(F.size("found") > 0), ["k1", "k2"]).select("k1", "k2", "found", words("text").alias("words"))
        near = materialize(near.select("k1", "k2", F.explode(F.transform("found", around)).alias("f")).select("k1", "k2", "f.*"), "near")
    places = near.withColumn("anchor", F.explode(F.array(*[_run_hash("near", F.col("p") - F.col("lo"), run) for run in runs]) if runs else F.array(F.lit(0).cast("long"))))
    hits = places.join(wins, "anchor").withColumn("start", F.col("p") - F.col("off"))
    same = (F.col("start") >= F.col("lo")) & (F.slice("near", F.greatest(F.col("start") - F.col("lo"), F.lit(0)) + 1, F.col("size")) == F.col("gram"))
    return hits.where(same).select("k1", "k2", "item", "start", "size").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """``k1, k2, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for every row of ``docs(doc_id, text)``.

    A word inside any occurrence of a window of ``benchmark(item_id, text)`` is hit; a document
    is contaminated when it has a hit and ``share * n_hit >= n_words``. ``spans`` are the hit
    places as merged ``start, end`` in words (null: none). Null and empty texts have no words,
    items without words or id have no windows. Rows that repeat an id and a text get the same
    result, null ids are ids, other columns are not looked at, empty tables give no hits, and
    long texts are scanned whole.
    """
    table = docs.select(*doc_key(), F.col("doc_id"), F.size(words("text")).cast("long").alias("n_words"))
    hits = window_hits(docs, benchmark, n, broadcast_bytes)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    per = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"), merged.alias("spans"))
    out = table.join(per, ["k1", "k2"], "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("k1", "k2", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "spans")
    return out.select("k1", "k2", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, remove: str = "documents", broadcast_bytes: int = 256 << 20) -> DataFrame:
    """``docs`` without its contaminated documents (``remove="documents"``) or without the hit words and the gaps before them (``"spans"``)."""
    found = contamination(docs, benchmark, n, share, broadcast_bytes)
    names = [F.col(f"`{c}`") for c in docs.columns]
    one, two, hit = own_names(docs, "__0", "__1", "__spans")
    k1, k2 = doc_key()
    keyed = docs.select(*names, k1.alias(one), k2.alias(two))
    if remove == "documents":
        bad = found.where("contaminated").select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct()
        return keyed.join(bad, [one, two], "left_anti").select(*names)
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    bad = found.where("spans is not null").select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("spans").alias(hit)).dropDuplicates([one, two])
    gap = GAP[1:-2].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # upper-case letters are in words here
    pieces = F.regexp_extract_all("text", F.lit(f"[{gap}]*[^{gap}]+|[{gap}]+$"), F.lit(0))
    clean = F.array_join(F.filter(pieces, lambda p, i: ~F.exists(hit, lambda s: (i >= s["start"]) & (i < s["end"]))), "")
    rows = keyed.join(bad, [one, two], "left")
    return rows.select(*[(F.when(F.col(hit).isNull(), F.col("text")).otherwise(clean).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])


__all__ = ["benchmark_windows", "contamination", "decontaminate", "window_hits"]
