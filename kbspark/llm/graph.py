"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm._store import discard, materialize


#: Parts of the rows under one root.
_SALT = 16


def with_root(rows: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``roots``, of which ``key`` has one row each; rows of one root are dealt over ``_SALT`` tasks."""
    dealt = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALT)).cast("int"))
    return salted.join(dealt, [key, "salt"], "left").drop("salt")


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links(a, b)``; ``comp`` is the least node that it reaches.

    Each round hangs every node under the least label of its neighbours, from the third on whole
    trees with it, and then halves the paths; no link, label or component leaves the executors. Rounds grow with the
    logarithm of the longest path. An empty table of links has no nodes.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    turn = 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        own = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("to"))
        if turn > 1:  # long paths: whole trees go under the least label that one of their nodes has seen
            hooks = own.where("to < comp").groupBy("comp").agg(F.min("to").alias("under"))
            own = with_root(own, "comp", hooks).select("node", "comp", F.least("to", F.coalesce("under", "to")).alias("to"))
        roots = own.select("to").distinct().join(own.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
        next_ = F.least("to", F.coalesce("far", "to"))
        fresh = materialize(with_root(own, "to", roots).select("node", next_.alias("comp"), (next_ != F.col("comp")).alias("moved")), "labels")
        done = not fresh.where("moved").limit(1).count()
        discard(labels)
        labels, turn = fresh.drop("moved"), turn + 1
        if done:
            discard(both)
            return labels
