"""Snapshots, diffs, rollback, index versions, pipeline state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators import chunking

#: States of documents that a snapshot holds, and the allowed steps.
ACTIVE = ("uploaded", "parsing", "processing", "pending_segment", "vectorizing", "ready", "error")
STEPS = {
    "uploaded": ("parsing", "error"),
    "parsing": ("processing", "error"),
    "processing": ("pending_segment", "error"),
    "pending_segment": ("vectorizing", "error", "processing"),
    "vectorizing": ("ready", "error"),
    "ready": ("archived", "pending_segment", "vectorizing", "error"),
    "error": ("parsing", "processing", "pending_segment", "vectorizing", "archived"),
    "archived": (),
}


def capture(kbs: DataFrame, docs: DataFrame, grants: DataFrame, chunk_count: str = "chunk_count") -> DataFrame:
    """Per base: number of active documents and chunks, hash of the documents' contents in order, grants as a sorted array."""
    d = docs.where(F.col("status").isin(*ACTIVE)).groupBy("kb_id").agg(F.count("*").alias("documents"), F.sum(chunk_count).alias("chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("raw_text", 256).alias("h")))), lambda x: x["h"]), ","), 256).alias("content"))
    g = grants.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", F.col("user_id").cast("string"), "permission_code"))).alias("permissions"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return kbs.join(d, "kb_id", "left").join(g, "kb_id", "left").select("kb_id", zero("documents"), zero("chunks"), "content", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"))


def diff(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``doc_id, change``: what a rollback would do; a null status in the snapshot does not count."""
    c, s = current.withColumn("__c", F.lit(True)).alias("c"), snapshot.withColumn("__s", F.lit(True)).alias("s")
    both = c.join(s, F.col("c.doc_id") == F.col("s.doc_id"), "full_outer")
    changed = F.lit(False)
    for name in ("content_hash", "chunk_count", "filename", "file_type"):
        changed = changed | ~F.col(f"c.{name}").eqNullSafe(F.col(f"s.{name}"))
    if "status" in snapshot.columns:
        changed = changed | (F.col("s.status").isNotNull() & ~F.col("c.status").eqNullSafe(F.col("s.status")))
    change = F.when(F.col("__c").isNull(), "added").when(F.col("__s").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    return both.select(F.coalesce("c.doc_id", "s.doc_id").alias("doc_id"), change.alias("change"))


def config_diff(current: DataFrame, snapshot: DataFrame, fields: list[str], key: str = "kb_id") -> DataFrame:
    """``key, field, old, new`` for each field that differs; values as text."""
    c, s = current.alias("c"), snapshot.alias("s")
    both = c.join(s, F.col(f"c.{key}") == F.col(f"s.{key}"))
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    items = F.array(*[F.struct(F.lit(f).alias("field"), text("s", f).alias("old"), text("c", f).alias("new")) for f in fields])
    return both.select(F.col(f"c.{key}").alias(key), F.explode(items).alias("i")).select(key, "i.*").where(~F.col("old").eqNullSafe(F.col("new")))


def preview(current: DataFrame, snapshot: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Changes of a rollback, whole or of some documents; a chosen id that neither side has is ``unknown``."""
    d = diff(current, snapshot).where("change <> 'unchanged'")
    if chosen is None:
        return d
    ids = chosen.select("doc_id").distinct()
    known = current.select("doc_id").unionByName(snapshot.select("doc_id"))
    unknown = ids.join(known, "doc_id", "left_anti").select("doc_id", F.lit("unknown").alias("change"))
    return d.join(ids, "doc_id", "left_semi").unionByName(unknown)


def rollback(current: DataFrame, snapshot: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``doc_id, content_hash, status`` after a rollback: restored rows, and rows as they are in ``current(doc_id, content_hash, status)``; a whole rollback archives these."""
    part = snapshot if chosen is None else snapshot.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    back = part.select("doc_id", "content_hash", F.when(F.col("content_hash").isNotNull(), "pending_segment").otherwise("error").alias("status"))
    rest = current.join(part.select("doc_id"), "doc_id", "left_anti").select("doc_id", "content_hash", F.lit("archived").alias("status") if chosen is None else "status")
    return back.unionByName(rest)


def rollback_tables(tables: dict[str, DataFrame], snapshot: DataFrame, config: DataFrame, permissions: DataFrame, snapshot_id: str, version: str, chosen: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a rollback of the bases in ``config`` makes of all tables it touches; ``TableSet.commit`` takes the result.

    ``tables``: ``docs(doc_id, kb_id, filename, file_type, content_hash, chunk_count, status)``,
    ``grants(kb_id, user_id, permission_code)``, ``kbs(kb_id, status, ...)``, ``index_versions(kb_id,
    version, status, chunk_count)``, ``version_docs(kb_id, version, doc_id)``, ``snapshots(snapshot_id,
    kb_id, trigger)`` and ``snapshot_docs(snapshot_id, ...)`` with the columns of ``docs``. The
    snapshot gives documents (without status), ``config(kb_id, chunk_size, chunk_overlap, ...)`` and
    permissions.

    - ``snapshots``, ``snapshot_docs``: a protection snapshot of what is there now;
    - ``docs``: restored rows (``pending_segment`` with a content, else ``uploaded``); others of these bases are archived by a whole rollback only;
    - ``grants`` and the settings in ``kbs``: as in the snapshot, by a whole rollback only; a setting that the snapshot has not stays;
    - ``index_versions``, ``version_docs``: a ``building`` version of every live document, chosen or not; the current version stays; the bases are ``vectorizing``.

    A base that is ``vectorizing`` is left as it is. Bases are told by ``kb_id``; rows without one stay.
    """
    docs, kbs = tables["docs"], tables["kbs"]
    free = kbs.where(~F.col("status").eqNullSafe("vectorizing")).join(config, "kb_id", "left_semi").select("kb_id")
    mine = lambda df: df.join(free, "kb_id", "left_semi")
    others = lambda df: df.join(free, "kb_id", "left_anti")
    guard = f"{snapshot_id}-{version}-protection"

    part = mine(snapshot) if chosen is None else mine(snapshot).join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    names = docs.columns
    back = part.withColumn("status", F.when(F.col("content_hash").isNotNull(), "pending_segment").otherwise("uploaded")).select(*names)
    rest = mine(docs).join(part, ["kb_id", "doc_id"], "left_anti")
    rest = rest.withColumn("status", F.lit("archived")) if chosen is None else rest
    after = back.unionByName(rest.select(*names))
    live = after.where("status NOT IN ('archived', 'deleted')")

    out = {
        "docs": others(docs).unionByName(after),
        "snapshots": tables["snapshots"].unionByName(free.select(F.lit(guard).alias("snapshot_id"), "kb_id", F.lit("rollback_protection").alias("trigger"))),
        "snapshot_docs": tables["snapshot_docs"].unionByName(mine(docs).withColumn("snapshot_id", F.lit(guard)).select(*tables["snapshot_docs"].columns)),
        "version_docs": tables["version_docs"].unionByName(live.select("kb_id", F.lit(version).alias("version"), "doc_id")),
    }
    sizes = live.groupBy("kb_id").agg(F.sum("chunk_count").alias("chunk_count"))
    new = free.join(sizes, "kb_id", "left").select("kb_id", F.lit(version).alias("version"), F.lit("building").alias("status"), F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"))
    out["index_versions"] = tables["index_versions"].unionByName(new)
    settings = [] if chosen is not None else [c for c in config.columns if c in kbs.columns and c not in ("kb_id", "status")]
    old = config.join(free, "kb_id", "left_semi").select("kb_id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in settings])
    both = kbs.join(old, "kb_id", "left")
    value = {c: F.coalesce(f"__{c}", c).alias(c) for c in settings} | {"status": F.when(F.col("__hit"), "vectorizing").otherwise(F.col("status")).alias("status")}
    out["kbs"] = both.select(*[value.get(c, F.col(c)) for c in kbs.columns])
    if chosen is None:
        out["grants"] = others(tables["grants"]).unionByName(mine(permissions).select(*tables["grants"].columns))
    return out


def compensate(protection: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks of the documents of a protection snapshot, cut again from their text."""
    return chunking.chunk(texts.join(protection.select(key), key, "left_semi"), key, text, "paragraph")


def prune_snapshots(snaps: DataFrame, now: str, days: int = 90, most: int = 50, excluded: DataFrame | None = None) -> DataFrame:
    """Snapshots to delete: too old; beyond the newest ``most`` of a base, protection snapshots not counted."""
    s = snaps if excluded is None else snaps.join(excluded.select("snapshot_id"), "snapshot_id", "left_anti")
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")
    w = Window.partitionBy("kb_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    young = s.where(~old & ~F.col("is_protection")).withColumn("n", F.row_number().over(w)).where(F.col("n") > most)
    return s.where(old).select("snapshot_id", F.lit("age").alias("reason")).unionByName(young.select("snapshot_id", F.lit("count").alias("reason")))


def activate(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Versions after ``chosen(kb_id, version)`` become current; a failed one can't, and leaves its base as it was."""
    c = chosen.select("kb_id", F.col("version").alias("__v"))
    both = versions.join(c, "kb_id", "left").withColumn("__ok", F.max((F.col("version") == F.col("__v")) & (F.col("status") != "failed")).over(Window.partitionBy("kb_id")))
    status = F.when(~F.coalesce("__ok", F.lit(False)), F.col("status")).when(F.col("version") == F.col("__v"), "current").when(F.col("status") == "current", "obsolete").otherwise(F.col("status"))
    return both.select("kb_id", "version", status.alias("status"))


def plan_revectorize(docs: DataFrame, rules: DataFrame, force: bool = False) -> DataFrame:
    """Documents to vectorise again: ready, failed or waiting ones, or all that are not archived."""
    some = docs.where("status <> 'archived'") if force else docs.where(F.col("status").isin("ready", "error", "pending_segment"))
    return chunking.resolve_rules(some, rules)


def plan_rebuild(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which documents need new chunks, and why."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    why = F.when(F.col("status").isin("uploaded", "error", "pending_segment"), F.col("status")).when(F.coalesce("n", F.lit(0)) == 0, "no_chunks")
    return docs.join(n, "doc_id", "left").select("doc_id", why.alias("reason")).where("reason IS NOT NULL")


def latest_task(tasks: DataFrame) -> DataFrame:
    """Per base the latest task, and whether any is still open."""
    open_ = F.col("status").isin("pending", "queued", "running")
    return tasks.groupBy("kb_id").agg(F.max_by(F.struct("task_id", "status"), F.struct("updated_at", "task_id")).alias("t"), F.bool_or(open_).alias("active"), F.floor(100 * F.count_if(~open_) / F.count("*")).alias("percent")).select("kb_id", "t.task_id", "t.status", "active", "percent")


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Steps of ``log(document_id, seq, status)`` that the state machine does not allow."""
    edges = log.sparkSession.createDataFrame([(a, b) for a, to in STEPS.items() for b in to], "before string, status string")
    step = log.withColumn("before", F.lag("status").over(Window.partitionBy("document_id").orderBy("seq"))).where("before IS NOT NULL")
    return step.join(F.broadcast(edges), ["before", "status"], "left_anti").select("document_id", "seq", "before", "status")


def error_messages(log: DataFrame) -> DataFrame:
    """A status log whose messages are kept in state ``error`` only."""
    return log.withColumn("error_message", F.when(F.col("status") == "error", F.col("error_message")))


def resolve_models(models: DataFrame) -> DataFrame:
    """The model to use per type: enabled, default first, then priority, then age."""
    w = Window.partitionBy("kind").orderBy(F.desc("is_default"), F.desc("priority"), "model_id")
    return models.where("enabled").withColumn("n", F.row_number().over(w)).where("n = 1").select("kind", "model_id")


def default_conflicts(models: DataFrame) -> DataFrame:
    return models.where("is_default").groupBy("kind").agg(F.count("*").alias("n")).where("n > 1")


def build_corpus(files: DataFrame, mode: str = "paragraph", embedder=None) -> tuple[DataFrame, DataFrame]:
    """Vectors, and the state of each file: admitted, decoded, normalised, cut and embedded in one plan; failures carry their error."""
    from kbspark.operators.retrieval import embed
    from kbspark.sources.files import admit_files, decode_files

    gate = admit_files(files)
    text = decode_files(gate.where("accepted").select("filename", "content"))
    ready = chunking.normalize(text.where("error IS NULL"), "text").select("filename", "normalized_text")
    chunks = chunking.chunk(ready, "filename", "normalized_text", mode)
    bad = gate.where("NOT accepted").select("filename", F.lit("error").alias("status"), F.col("reason").alias("error"))
    state = bad.unionByName(text.select("filename", F.when(F.col("error").isNull(), "ready").otherwise("error").alias("status"), "error"))
    return embed(chunks, "content", embedder), state
