"""Streams with keyed state: timers, chained steps, late rows, sorted replay of a client's requests, restartable ingest.

State is kept by Spark's RocksDB provider, so it may be larger than an executor's memory.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from kbspark.sources.shared import new_path
from kbspark.streaming.jobs import DELAY, drain

MICROS = 1_000_000
OPEN = ("pending", "queued", "running")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as ``transformWithState`` needs; the setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain_state(df: DataFrame, mode: str = "append") -> DataFrame:
    with rocksdb(df.sparkSession):
        return drain(df, mode)


def merge_spans(spans: list[tuple[int, int, bool]], times: np.ndarray, gap: int) -> list[tuple[int, int, bool]]:
    """Spans ``(start, end, told)`` after more times: what lies at most ``gap`` apart is one span, told if a part of it was."""
    times = np.sort(times)
    cut = np.flatnonzero(np.diff(times) > gap) + 1
    edges = np.concatenate([[0], cut, [len(times)]]) if len(times) else np.zeros(1, int)
    new = [(int(times[a]), int(times[b - 1]), False) for a, b in zip(edges, edges[1:])]
    out: list[tuple[int, int, bool]] = []
    for start, end, told in sorted(spans + new):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] or told)
        else:
            out.append((start, end, told))
    return out


class _Changes(StatefulProcessor):
    """Open spans of a key. A change is told once the watermark has passed its moment, when no row can alter it any more."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spans", "seen boolean, timer long, starts array<long>, ends array<long>, told array<boolean>")

    def _load(self) -> tuple[bool, int, list[tuple[int, int, bool]]]:
        if not self.state.exists():
            return False, -1, []
        seen, timer, starts, ends, told = self.state.get()
        return seen, timer, list(zip(starts, ends, told))

    def _keep(self, seen: bool, timer: int, spans: list[tuple[int, int, bool]]) -> None:
        """One timer a key, at the next moment that something is to be told."""
        due = min((end + self.gap if told else start for start, end, told in spans), default=None)
        at = -1 if due is None else -(-due // 1000)
        if at != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if at >= 0:
                self.handle.registerTimer(at)
        self.state.update((seen, at, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, timer, spans = self._load()
        for pdf in rows:
            spans = merge_spans(spans, pdf["moment"].to_numpy(np.int64), self.gap)
        self._keep(seen, timer, spans)
        yield pd.DataFrame({self.key: pd.Series(dtype="int64"), "moment": pd.Series(dtype="int64"), "change": pd.Series(dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        seen, _, spans = self._load()
        out, rest = [], []
        for start, end, told in spans:
            if not told and start <= mark:
                out.append((start, "reactivated" if seen else "active"))
                seen = told = True
            if told and end + self.gap <= mark:
                out.append((end + self.gap, "expired"))
            else:
                rest.append((start, end, told))
        self._keep(seen, -1, rest)
        yield pd.DataFrame({self.key: [key[0]] * len(out), "moment": [o[0] for o in out], "change": [o[1] for o in out]}).astype({self.key: "int64", "moment": "int64", "change": object})

    def close(self) -> None:
        pass


def session_changes(rows: DataFrame, key: str = "user_id", ts: str = "ts", minutes: int = 30) -> DataFrame:
    """``key, moment, change``: ``active`` at the first turn, ``expired`` when ``minutes`` pass without one, ``reactivated`` at the next.

    ``key`` is a long, ``moment`` microseconds since the epoch. A stream tells a change when
    its watermark (10 minutes behind) has passed it, so turns may come in any order within that; later
    ones are dropped. A batch DataFrame is the specification: its watermark is its last turn, in whole milliseconds, less the delay.
    Rows without key or time are left out.
    """
    gap = minutes * 60 * MICROS
    some = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(ts).cast("timestamp").alias("__ts")).withColumn("moment", F.unix_micros("__ts"))
    if rows.isStreaming:
        return some.withWatermark("__ts", DELAY).groupBy(key).transformWithStateInPandas(_Changes(key, gap), f"{key} long, moment long, change string", "append", "EventTime")
    w = Window.partitionBy(key).orderBy("moment")
    mark = some.agg((1000 * F.floor(F.max("moment") / 1000) - int(DELAY.split()[0]) * 60 * MICROS).alias("mark"))
    steps = some.select(key, "moment", F.lag("moment").over(w).alias("before"), F.lead("moment").over(w).alias("after"))
    begins = F.when(F.col("before").isNull(), "active").when(F.col("moment") - F.col("before") > gap, "reactivated")
    ends = F.when(F.col("after").isNull() | (F.col("after") - F.col("moment") > gap), "expired")
    each = steps.select(key, F.explode(F.array(F.struct("moment", begins.alias("change")), F.struct((F.col("moment") + gap).alias("moment"), ends.alias("change")))).alias("c")).select(key, "c.*").where("change IS NOT NULL")
    return each.join(F.broadcast(mark), F.col("moment") <= F.col("mark")).select(key, "moment", "change")


class LateRows(StreamingQueryListener):
    """Counts, by query id, the rows that stateful steps dropped as later than the watermark.

    Steps that see rows (``session_changes``, duplicates) count rows; a windowed aggregate counts the
    groups that its map side made of them. ``spark.streams.addListener`` starts it.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()
        self.batches: Counter[str] = Counter()
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches[str(p.id)] += 1
        self.dropped[str(p.id)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


class _Latest(StatefulProcessor):
    """The latest status of a base; tells how the open statuses change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "at long, task_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        best = old
        for pdf in rows:
            row = pdf.sort_values(["at", "task_id"]).iloc[-1]
            if best is None or (row["at"], row["task_id"]) > (best[0], best[1]):
                best = (int(row["at"]), int(row["task_id"]), row["status"])
        if best is not old:
            self.state.update(tuple(best))
        before, after = old[2] if old else None, best[2]
        step = [] if before == after else [(s, d) for s, d in ((before, -1), (after, 1)) if s in OPEN]
        yield pd.DataFrame({"status": [s for s, _ in step], "step": [d for _, d in step]}).astype({"status": object, "step": "int64"})

    def close(self) -> None:
        pass


class _Depth(StatefulProcessor):
    """The running number of bases in one status; ``turn`` orders what it tells."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("depth", "n long, turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, turn = self.state.get() if self.state.exists() else (0, 0)
        n, turn = int(n + sum(int(pdf["step"].sum()) for pdf in rows)), turn + 1
        self.state.update((n, turn))
        yield pd.DataFrame({"status": [key[0]], "n": [n], "turn": [turn]})

    def close(self) -> None:
        pass


def queue_depth_changes(tasks: DataFrame) -> DataFrame:
    """``status, n, turn`` of a stream ``tasks(kb_id, updated_at, task_id, status)``: two chained steps, the latest status of each base, then the number of bases in each open status; the row with the last ``turn`` holds."""
    rows = tasks.select("kb_id", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), "task_id", "status")
    steps = rows.groupBy("kb_id").transformWithStateInPandas(_Latest(), "status string, step long", "append", "None")
    return steps.groupBy("status").transformWithStateInPandas(_Depth(), "status string, n long, turn long", "append", "None")


def depth_now(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.max_by("n", "turn").alias("n")).where("n > 0")


def limit_requests(requests: DataFrame, limit: int, seconds: float, before: DataFrame | None = None) -> DataFrame:
    """``user_id, event_id, admitted, times``: requests in order of ``ts, event_id``; only admitted ones of the last ``seconds`` count.

    The row of a user without ``event_id`` holds the times (microseconds) that still count after it;
    ``before(user_id, times)`` are those of an earlier call. Spark sorts the rows of a task on disk if
    need be, and Python sees them batch by batch, at most ``limit`` times held.
    """
    schema, span = "user_id long, event_id long, admitted boolean, times array<long>", int(seconds * MICROS)
    none = F.lit(None).cast("array<long>")
    rows = requests.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), none.alias("times")).where("user_id IS NOT NULL AND at IS NOT NULL")
    if before is not None:
        lit = F.lit(None).cast("long")
        rows = rows.unionByName(before.select("user_id", lit.alias("event_id"), lit.alias("at"), "times"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, deque()
        for pdf in batches:
            users, ids, ok, times = [], [], [], []
            for u, e, at, old in zip(pdf["user_id"], pdf["event_id"], pdf["at"], pdf["times"]):
                if u != user:
                    if user is not None:
                        users.append(user), ids.append(None), ok.append(None), times.append(list(held))
                    user, held = u, deque()
                if old is not None:  # sorted first: the times of an earlier call
                    held.extend(int(t) for t in old)
                    continue
                while held and at - held[0] > span:
                    held.popleft()
                free = len(held) < limit
                if free:
                    held.append(int(at))
                users.append(u), ids.append(e), ok.append(free), times.append(None)
            yield pd.DataFrame({"user_id": users, "event_id": pd.array(ids, "Int64"), "admitted": pd.array(ok, "boolean"), "times": times})
        if user is not None:
            yield pd.DataFrame({"user_id": [user], "event_id": pd.array([None], "Int64"), "admitted": pd.array([None], "boolean"), "times": [list(held)]})

    order = [F.asc("user_id"), F.asc_nulls_first("at"), F.asc("event_id")]
    return rows.repartition("user_id").sortWithinPartitions(*order).mapInPandas(run, schema)


def limiter_stream(requests: DataFrame, limit: int, seconds: float, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """``user_id, event_id, admitted`` of a stream, all that is there.

    Each micro-batch starts from the times that the one before has left under ``path`` and writes its
    own folder, so one that runs again replaces what it wrote. Times older than the newest of all by
    ``seconds`` and the 10 minutes of delay are dropped with their users.
    """
    spark = requests.sparkSession
    path = path or new_path(spark, "limiter")
    keep = int(seconds * MICROS) + int(DELAY.split()[0]) * 60 * MICROS

    def step(batch: DataFrame, n: int) -> None:
        before = None
        if n:
            left = batch.sparkSession.read.schema("user_id long, event_id long, admitted boolean, times array<long>").parquet(f"{path}/__batch={n - 1}").where("event_id IS NULL")
            newest = left.agg(F.max(F.array_max("times")).alias("newest"))
            before = left.join(F.broadcast(newest), F.array_max("times") >= F.col("newest") - keep).select("user_id", "times")
        limit_requests(batch, limit, seconds, before).write.mode("overwrite").parquet(f"{path}/__batch={n}")

    query = requests.writeStream.option("checkpointLocation", checkpoint or f"{path}-state").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return spark.read.parquet(path).where("event_id IS NOT NULL").select("user_id", "event_id", "admitted")


def ingest(files: DataFrame, path: str, checkpoint: str, build=None) -> None:
    """Build the corpus of new files into ``path``, each file name once, for all that is there now.

    The caller's ``checkpoint`` holds the place in the stream and, as keyed state, the names that are
    built, so a later call goes on where this one ended. A micro-batch writes the folder of its own
    number; one that was written but not committed runs again with the same files and replaces it.
    ``build`` takes a batch of files (default: vectors by ``build_corpus``).
    """
    if build is None:
        from kbspark.operators.versions import build_corpus

        build = lambda batch: build_corpus(batch)[0]
    with rocksdb(files.sparkSession):
        new = files.where("filename IS NOT NULL").dropDuplicates(["filename"])
        query = new.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: build(batch).write.mode("overwrite").parquet(f"{path}/__batch={n}")).start()
    query.awaitTermination()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("__batch")
