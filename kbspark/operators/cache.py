"""Question cache: mining, lookup, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import question_key


def mine_history(messages: DataFrame, sessions: DataFrame, user_roles: DataFrame, cached: DataFrame, as_of: str, days: int = 7, n: int = 5) -> DataFrame:
    """Frequent questions per role that are not cached yet, with their latest answer.

    Counts user messages of the last ``days`` in sessions that are not deleted; equal counts: the
    later last message first. Of the first ``3 n`` keys those with an answer stay, ``n`` at most.
    """
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")
    live = sessions.where("status <> 'deleted' AND user_id IS NOT NULL").select("session_id", "user_id")
    asked = messages.where("role = 'user'").where(F.col("created_at") >= since).join(live, "session_id").join(user_roles.select("user_id", F.col("role").alias("for_role")).distinct(), "user_id")
    last = F.struct("created_at", "message_id")
    keys = asked.withColumn("key", question_key("content")).where("key <> ''").groupBy("for_role", "key").agg(F.count("*").alias("n"), F.max(last).alias("last"), F.max_by(F.struct("request_id", "content"), last).alias("m"))
    keys = keys.join(cached.select(F.col("role").alias("for_role"), "key"), ["for_role", "key"], "left_anti")
    w = Window.partitionBy("for_role").orderBy(F.desc("n"), F.desc("last"), "key")
    walked = keys.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 3 * n)
    answers = messages.where("role = 'assistant' AND trim(content) <> ''").groupBy("request_id").agg(F.max_by("content", last).alias("answer"))
    found = walked.select("for_role", "key", "n", "place", F.col("m.request_id").alias("request_id"), F.col("m.content").alias("question")).join(answers, "request_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("for_role").orderBy("place"))).where(F.col("rank") <= n).drop("place")


def lookup(questions: DataFrame, cache: DataFrame, scope: DataFrame) -> DataFrame:
    """The newest cached entry for each question whose source bases, not none, are all within the user's.

    ``questions(question_id, role, user_id, question)``, ``cache(entry_id, role, key, enabled, source_kbs, updated_at)``, ``scope(user_id, kbs)``.
    What fits depends on role, key and the user's bases alone: each such triple meets the newest entry of each set of bases once.
    """
    none = F.array().cast("array<string>")
    scopes = scope.select("user_id", F.array_sort(F.array_distinct(F.coalesce("kbs", none))).alias("kbs"))
    q = questions.select("question_id", "role", "user_id", question_key("question").alias("key")).join(scopes, "user_id", "left").withColumn("kbs", F.coalesce("kbs", none))
    newest = F.struct("updated_at", "entry_id").alias("entry")
    sets = cache.where("enabled").where(F.size("source_kbs") > 0).withColumn("source_kbs", F.array_sort(F.array_distinct("source_kbs")))
    entries = sets.select("role", "key", "source_kbs", newest).groupBy("role", "key", "source_kbs").agg(F.max("entry").alias("entry"))
    fits = q.select("role", "key", "kbs").distinct().join(entries, ["role", "key"]).where(F.size(F.array_except("source_kbs", "kbs")) == 0)
    answers = fits.groupBy("role", "key", "kbs").agg(F.max("entry").alias("entry"))
    return q.join(answers, ["role", "key", "kbs"]).groupBy("question_id").agg(F.max("entry").alias("entry")).select("question_id", "entry.entry_id")


def hit_counts(found: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(found.groupBy("entry_id").agg(F.count("*").alias("new")), "entry_id", "left").select("entry_id", (F.col("hits") + F.coalesce("new", F.lit(0))).alias("hits"))


def replace_generated(cache: DataFrame, items: DataFrame) -> DataFrame:
    """New generated entries in place of the old ones; entries of another source with the same key are updated instead."""
    stay = cache.where("source <> 'document'").join(items.select("role", "key", F.col("answer").alias("fresh")), ["role", "key"], "left")
    kept = stay.select("role", "key", F.coalesce("fresh", "answer").alias("answer"), "source")
    new = items.join(kept.select("role", "key"), ["role", "key"], "left_anti").select("role", "key", "answer", F.lit("document").alias("source"))
    return kept.unionByName(new)


def due_jobs(configs: DataFrame, now: str) -> DataFrame:
    """``role, kind`` of enabled jobs that never ran, or not within their interval."""
    kinds = configs.where("enabled").selectExpr("role", "interval_days", "stack(2, 'documents', last_documents, 'history', last_history) AS (kind, last_run)")
    old = F.col("last_run") <= F.lit(now).cast("timestamp") - F.make_dt_interval("interval_days")
    return kinds.where(F.col("last_run").isNull() | old).select("role", "kind")


def source_kbs(meta: str | Column) -> Column:
    """Valid base ids of an answer's metadata: its own list, else that of the cached answer."""
    m = F.col(meta) if isinstance(meta, str) else meta
    read = lambda path: F.from_json(F.get_json_object(m, path), "array<string>")
    own = F.coalesce(read("$.kb_ids"), F.array().cast("array<string>"))
    chosen = F.when(F.size(own) > 0, own).otherwise(F.coalesce(read("$.cached.kb_ids"), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(chosen, lambda x: x.rlike("^src[0-9]+$")))


def ensure_configs(configs: DataFrame, roles: DataFrame, interval: int = 7) -> DataFrame:
    """A default configuration for every role that has none."""
    missing = roles.select("role").distinct().join(configs.select("role"), "role", "left_anti")
    return configs.select("role", "interval_days").unionByName(missing.select("role", F.lit(interval).alias("interval_days")))
