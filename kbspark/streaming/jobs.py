"""Structured Streaming jobs. Each takes a streaming or a batch DataFrame, so that a batch run is its specification.

Watermarks are 10 minutes throughout; later rows are dropped. Counters run in complete or update
mode, stateless jobs in append mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions.text import redact, screen
from kbspark.operators.trends import BOUNDS, histogram_quantile
from kbspark.sources.shared import new_path

DELAY = "10 minutes"
#: Path rules of the limiter, first match wins; prefix, limit per minute.
RULES = (("/api/v1/auth/login", 20), ("/api/v1/auth/register", 10), ("/api/v1/qa/ask", 60), ("/api/v1/", 300))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, one file or a folder of files, as a stream of its files; zoneless times become timestamps of the session, as watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    out = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return out.select(*[F.col(n).cast("timestamp").alias(n) if k == "timestamp_ntz" else F.col(n) for n, k in out.dtypes])


def drain(df: DataFrame, mode: str, then: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Run a stream over all that is there and return what its sink holds; in complete mode the last batch counts.

    Each batch has a folder of its own, so that a batch that runs again replaces what it wrote.
    """
    spark = df.sparkSession
    path = new_path(spark, "stream")
    folder = lambda n: f"{path}/__batch={0 if mode == 'complete' else n}"
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(lambda batch, n: then(batch).write.mode("overwrite").parquet(folder(n))).start()
    query.awaitTermination()
    return spark.read.parquet(path).drop("__batch")


def screen_stream(stream: DataFrame, text: str) -> DataFrame:
    """Blocked questions as events: masked preview, fingerprint, intent and reason."""
    return stream.withColumn("v", screen(text)).where("NOT v.allowed").select("message_id", "v.intent", "v.reason_code", redact(text).alias("preview"), F.sha2(text, 256).alias("fingerprint"))


def error_ratio(stream: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """``start, n, errors`` per sliding window."""
    return stream.withWatermark("ts", DELAY).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors")).select(F.unix_timestamp("w.start").alias("start"), "n", "errors")


def hold(ratios: DataFrame, share: float = 0.05, windows: int = 5) -> DataFrame:
    """Windows whose ratio, and that of each of the minutes before, were above ``share``; a minute without a window ends the alarm.

    Windows are dealt by day, so no one task gets them all; the last ones of a day are in the next
    day's group too, as its first ones look back at them.
    """
    span, day = 60 * (windows - 1), F.floor(F.col("start") / 86400)
    r = ratios.withColumn("day", F.explode(F.array_distinct(F.array(day, F.floor((F.col("start") + span) / 86400))))).withColumn("over", (F.col("errors") / F.col("n") > share).cast("int"))
    w = Window.partitionBy("day").orderBy("start").rangeBetween(-span, 0)
    held = r.withColumns({"held": F.min("over").over(w), "seen": F.count("*").over(w)}).where((F.col("held") == 1) & (F.col("seen") == windows) & (F.col("day") == day))
    return held.select("start", "n", "errors")


def latency_histogram(stream: DataFrame, width: str = "6 hours") -> DataFrame:
    """Cumulative latency buckets per window, one row each."""
    cols = [F.count_if(F.col("latency_s") <= b).alias(f"b{i}") for i, b in enumerate((*BOUNDS, float("inf")))]
    return stream.withWatermark("ts", DELAY).groupBy(F.window("ts", width).alias("w")).agg(*cols).select(F.unix_timestamp("w.start").alias("start"), *[f"b{i}" for i in range(len(cols))])


def quantiles(hist: DataFrame, q: float) -> DataFrame:
    edges = (*BOUNDS, float("inf"))
    rows = hist.select("start", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(edges)])).alias("p")).select("start", "p.*")
    return histogram_quantile(rows, q, ["start"])


def limit_of(path: str, factor: float = 1.0):
    out = None
    for prefix, limit in RULES:
        hit = F.startswith(F.col(path), F.lit(prefix))
        out = F.when(hit, limit * factor) if out is None else out.when(hit, limit * factor)
    return out


def rate_breaches(stream: DataFrame, width: str = "1 minute", factor: float = 1.0) -> DataFrame:
    """Clients over their limit in windows from the epoch on; ``factor`` scales the limits."""
    per = stream.withColumn("lim", limit_of("path", factor)).where("lim IS NOT NULL").withWatermark("ts", DELAY).groupBy(F.window("ts", width).alias("w"), "user_id", "lim").agg(F.count("*").alias("n"))
    return per.where("n > lim").select(F.unix_timestamp("w.start").alias("start"), "user_id", "n")


def session_windows(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per user: they end after ``gap`` without an event and the next one starts another."""
    return stream.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("expires"), "n")


def live_context(messages: DataFrame, most: int = 20) -> DataFrame:
    """``session_id, message_id``: each message that ``most`` newer ones (by turn, then id) have pushed out of its session's window.

    Streams keep the window as state and take a session's rows piece by piece, so the order of arrival does not matter.
    """
    if not messages.isStreaming:
        back = Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("message_id"))
        return messages.withColumn("__n", F.row_number().over(back)).where(F.col("__n") > most).select("session_id", "message_id")

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turns, ids = state.get if state.exists else ([], [])
        window = pd.DataFrame({"turn": turns, "message_id": ids}, dtype="int64")
        for pdf in pdfs:
            both = pd.concat([window, pdf[["turn", "message_id"]].astype("int64")]).sort_values(["turn", "message_id"])
            gone, window = both.iloc[:-most], both.iloc[-most:]
            yield pd.DataFrame({"session_id": key[0], "message_id": gone["message_id"]}).astype("int64")
        state.update((window["turn"].tolist(), window["message_id"].tolist()))

    some = messages.select("session_id", "message_id", "turn")
    return some.groupBy("session_id").applyInPandasWithState(step, "session_id long, message_id long", "turns array<long>, ids array<long>", "append", "NoTimeout")


def latest_status(tasks: DataFrame) -> DataFrame:
    """The latest status per base; ``queue_depth`` counts the open ones."""
    return tasks.groupBy("kb_id").agg(F.max_by("status", F.struct("updated_at", "task_id")).alias("status"))


def queue_depth(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("status").isin("pending", "queued", "running")).groupBy("status").agg(F.count("*").alias("n"))


def hourly_errors(*sources: DataFrame) -> DataFrame:
    """``start, n`` per hour over several sources of ``ts``."""
    every = sources[0].select("ts")
    for s in sources[1:]:
        every = every.unionByName(s.select("ts"))
    return every.withWatermark("ts", DELAY).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "n")


def usage_counters(usage: DataFrame) -> DataFrame:
    """Running totals by model and direction."""
    per = usage.select("model", F.explode(F.array(F.struct(F.lit("input").alias("direction"), F.col("input_tokens").alias("tokens")), F.struct(F.lit("output").alias("direction"), F.col("output_tokens").alias("tokens")))).alias("u"))
    return per.groupBy("model", "u.direction").agg(F.sum("u.tokens").alias("tokens"))
