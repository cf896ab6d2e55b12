"""Counts, trends and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import department, normalize_path

#: Bounds of the request-latency histogram in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def department_counts(departments: DataFrame, users: DataFrame, kbs: DataFrame) -> DataFrame:
    members = users.groupBy(department("department").alias("code")).agg(F.count("*").alias("members"))
    live = kbs.where("status <> 'archived'").groupBy(department("department").alias("code")).agg(F.count("*").alias("kbs"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return departments.join(members, "code", "left").join(live, "code", "left").select("code", zero("members"), zero("kbs"))


def kb_totals(docs: DataFrame) -> DataFrame:
    return docs.where("status <> 'archived'").groupBy("kb_id").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("chunk_count"), F.lit(0).cast("long")).alias("n_chunks"))


def platform_stats(users: DataFrame, kbs: DataFrame, docs: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of counters; one pass of each table, joined as single rows."""
    parts = [users.agg(F.count("*").alias("users")), kbs.agg(F.count_if(F.col("status") != "deleted").alias("kbs")), docs.agg(F.count("*").alias("docs")), tasks.agg(F.count_if(F.col("status").isin("pending", "queued", "running")).alias("queued")), sessions.agg(F.count_if(F.col("status") == "active").alias("active_sessions"))]
    out = parts[0].withColumn("__k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


def calendar(df: DataFrame, as_of: str, n: int, unit: str) -> DataFrame:
    """``slot``: the last ``n`` days or hours up to and with that of ``as_of``."""
    end = F.date_trunc(unit, F.lit(as_of).cast("timestamp"))
    step = F.expr(f"INTERVAL 1 {unit}")
    return df.sparkSession.range(1).select(F.explode(F.sequence(end - step * (n - 1), end, step)).alias("slot"))


def _bounded(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"1 to {most}")
    return n


def daily(events: DataFrame, ts: str, as_of: str, days: int, **sums: Column) -> DataFrame:
    """``slot`` and sums per day, zeros for empty days."""
    days = _bounded(days, 90)
    per = events.groupBy(F.date_trunc("day", ts).alias("slot")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return calendar(events, as_of, days, "day").join(per, "slot", "left").select("slot", *[F.coalesce(k, F.lit(0)).alias(k) for k in sums])


def qa_trend(messages: DataFrame, as_of: str, days: int) -> DataFrame:
    return daily(messages.where("role = 'user'"), "created_at", as_of, days, n=F.lit(1).cast("long")).select(F.date_format("slot", "yyyy-MM-dd").alias("day"), "n")


def hit_rate_trend(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    d = daily(runs.where("status = 'completed'"), "started_at", as_of, days, hits=F.col("hit_count"), total=F.col("total_questions"))
    return d.select(F.date_format("slot", "yyyy-MM-dd").alias("day"), F.round(F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0), 4).alias("hit_rate"))


def error_hourly(sources: list[tuple[DataFrame, str]], as_of: str, hours: int) -> DataFrame:
    """``hour, n`` over several sources of error rows, zeros for quiet hours."""
    hours = _bounded(hours, 168)
    every = None
    for df, ts in sources:
        part = df.select(F.date_trunc("hour", ts).alias("slot"))
        every = part if every is None else every.unionByName(part)
    per = every.groupBy("slot").agg(F.count("*").alias("n"))
    return calendar(every, as_of, hours, "hour").join(per, "slot", "left").select(F.date_format("slot", "yyyy-MM-dd HH").alias("hour"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def rebucket(series: DataFrame, order: str, value: str, hours: int, buckets: int) -> DataFrame:
    """An hourly series as equal buckets, oldest first."""
    at = F.row_number().over(Window.orderBy(order)) - 1  # one short series: its hours are bounded by ``hours``
    return series.withColumn("bucket", F.floor(at * buckets / F.lit(hours)).cast("int")).groupBy("bucket").agg(F.sum(value).alias(value))


def guard_stats(events: DataFrame, as_of: str, latest: int = 10) -> tuple[DataFrame, DataFrame]:
    """Blocked questions in the last day and week by reason, and the latest ones."""
    end = F.lit(as_of).cast(dict(events.dtypes)["ts"])
    since = lambda days: F.count_if((F.col("ts") <= end) & (F.col("ts") > end - F.expr(f"INTERVAL {days} DAY")))
    per = events.groupBy("reason").agg(since(1).alias("day"), since(7).alias("week"))
    last = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(latest).select("event_id", F.coalesce("label", F.lit("unknown")).alias("label"))
    return per, last


def model_usage(usage: DataFrame, days: int, as_of: str) -> DataFrame:
    """Totals per model and in all (model null), by tokens; a total that is missing or 0 is input plus output."""
    _bounded(days, 180)
    total = F.when(F.coalesce("total_tokens", F.lit(0)) > 0, F.col("total_tokens")).otherwise(F.col("input_tokens") + F.col("output_tokens"))
    some = usage.where(F.col("day") > F.date_sub(F.to_date(F.lit(as_of)), days)).withColumns({"model": F.coalesce("model", F.lit("unknown")), "total": total})
    return some.rollup("model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total").alias("total_tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def usage_daily(usage: DataFrame) -> DataFrame:
    """Per model the array of days with their tokens and cost, in order."""
    per = usage.groupBy("model", "day").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return per.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("day", "tokens"))).alias("days"))


def cache_overview(configs: DataFrame, cache: DataFrame) -> DataFrame:
    n = cache.groupBy("role").agg(F.count("*").alias("n"))
    return configs.join(n, "role", "left").select("role", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def repair_counters(snaps: DataFrame, members: DataFrame) -> DataFrame:
    """Snapshot totals, recounted where the stored ones are 0."""
    real = members.groupBy("snapshot_id").agg(F.count("*").alias("docs"), F.sum("chunk_count").alias("chunks"))
    fix = lambda have, c: F.when(F.col(have) == 0, F.coalesce(c, F.lit(0))).otherwise(F.col(have)).cast("long").alias(have)
    return snaps.join(real, "snapshot_id", "left").select("snapshot_id", fix("document_count", "docs"), fix("total_chunks", "chunks"))


def http_rollup(requests: DataFrame) -> DataFrame:
    """Counts and latency per method, normalised path and status, without the metrics page."""
    r = requests.where("path <> '/metrics'").withColumn("route", normalize_path("path"))
    return r.groupBy("method", "route", "status").agg(F.count("*").alias("n"), F.round(F.sum("latency_s"), 6).alias("seconds"), F.round(F.max("latency_s"), 6).alias("slowest"))


def histogram(df: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """``by, le, cum``: cumulative counts under each bound and in all, in one pass."""
    edges = [*bounds, float("inf")]
    per = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(edges)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(edges)])
    return per.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", "p.cum")


def histogram_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Linear interpolation inside the bucket that holds the quantile; beyond the last bound that bound."""
    w = Window.partitionBy(*by).orderBy("le")
    h = hist.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "before": F.coalesce(F.lag("cum").over(w), F.lit(0)), "all": F.max("cum").over(Window.partitionBy(*by))})
    at = F.col("all") * q
    here = h.where((F.col("cum") >= at) & (F.col("before") < at))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (at - F.col("before")) / (F.col("cum") - F.col("before"))
    return here.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("value"))


def rate(df: DataFrame, ts: str, by: list[str], width: str = "5 minutes", step: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Events per second in sliding windows."""
    return df.groupBy(F.window(ts, width, step).alias("w"), *by).agg((F.count("*") / F.lit(seconds)).alias("rate")).select(F.unix_timestamp("w.start").alias("start"), *by, "rate")


def error_rate(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of 5xx."""
    return df.groupBy(*by).agg((F.count_if(F.col("status") >= 500) / F.greatest(F.count("*").cast("double"), F.lit(1e-9))).alias("ratio"))


def stage_latency(perf: DataFrame) -> DataFrame:
    """Per stage of ``perf(stages map<string,double>)``: count, mean, share of all time."""
    rows = perf.select(F.explode("stages").alias("stage", "ms")).groupBy("stage").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    return rows.select("stage", "n", F.round(F.col("ms") / F.col("n"), 4).alias("mean"), F.round(F.col("ms") / F.sum("ms").over(Window.partitionBy(F.lit(1))), 4).alias("share"))


def pipeline_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step", "result").agg(F.count("*").alias("n"))
