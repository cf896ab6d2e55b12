"""Queries of snapshots, versions and pipeline state."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import versions as V
from kbspark.plans import segment_sql as Q
from kbspark.plans.registry import query
from kbspark.sources.shared import new_path
from kbspark.sources.tables import TableSet


@query("WITH d AS (SELECT kb_id, count(*) AS documents, sum(doc_id % 9)::BIGINT AS chunks, sha256(string_agg(sha256(raw_text), ',' ORDER BY doc_id)) AS content FROM docs WHERE status <> 'archived' GROUP BY kb_id), g AS (SELECT kb_id, count(*) AS n FROM grants GROUP BY kb_id) SELECT k.kb_id, coalesce(d.documents, 0) AS documents, coalesce(d.chunks, 0) AS chunks, d.content, coalesce(g.n, 0)::INT AS n_permissions FROM kbs AS k LEFT JOIN d ON d.kb_id = k.kb_id LEFT JOIN g ON g.kb_id = k.kb_id")
def ver01_capture(t):
    out = V.capture(t.kbs, t.docs.withColumn("chunk_count", F.col("doc_id") % 9), t.grants)
    return out.select("kb_id", "documents", "chunks", "content", F.size("permissions").alias("n_permissions"))


_DIFF = "df AS (SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'added' WHEN s.doc_id IS NULL THEN 'removed' WHEN c.content_hash <> s.content_hash OR c.chunk_count <> s.chunk_count OR c.filename <> s.filename OR c.file_type <> s.file_type THEN 'modified' ELSE 'unchanged' END AS change FROM current_docs AS c FULL OUTER JOIN snapshot_docs AS s ON s.doc_id = c.doc_id)"


@query(f"WITH {_DIFF} SELECT * FROM df")
def ver02_diff(t):
    return V.diff(t.current_docs, t.snapshot_docs)


@query("SELECT kb_id, 'name' AS field, name || '!' AS old, name AS new FROM kbs WHERE creator_id % 3 = 0 UNION ALL SELECT kb_id, 'department' AS field, 'A' AS old, department AS new FROM kbs WHERE department IS NULL OR department <> 'A'")
def ver03_config_diff(t):
    old = t.kbs.withColumn("name", F.when(F.col("creator_id") % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))).withColumn("department", F.lit("A"))
    return V.config_diff(t.kbs, old, ["name", "department", "status"])


@query(f"WITH {_DIFF}, c AS (SELECT doc_id FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT -1 - doc_id AS doc_id FROM documents WHERE doc_id < 3) SELECT doc_id, change FROM df WHERE change <> 'unchanged' AND doc_id IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, 'unknown' AS change FROM c WHERE doc_id NOT IN (SELECT doc_id FROM df)")
def ver04_preview(t):
    chosen = t.documents.where("doc_id % 4 = 0").select("doc_id").unionByName(t.documents.where("doc_id < 3").selectExpr("-1 - doc_id AS doc_id"))
    return V.preview(t.current_docs, t.snapshot_docs, chosen)


@query("SELECT doc_id, content_hash, 'pending_segment' AS status FROM snapshot_docs UNION ALL SELECT doc_id, content_hash, 'archived' AS status FROM current_docs WHERE doc_id NOT IN (SELECT doc_id FROM snapshot_docs)")
def ver05_rollback(t):
    return V.rollback(_current(t), t.snapshot_docs)


def _current(t):
    return t.current_docs.join(t.docs.select("doc_id", "status"), "doc_id")


@query("WITH p AS (SELECT * FROM snapshot_docs WHERE doc_id % 4 = 0) SELECT doc_id, content_hash, 'pending_segment' AS status FROM p UNION ALL SELECT c.doc_id, c.content_hash, d.status FROM current_docs AS c JOIN docs AS d ON d.doc_id = c.doc_id WHERE c.doc_id NOT IN (SELECT doc_id FROM p)", name="ver05_rollback_selective")
def ver05_rollback_selective(t):
    return V.rollback(_current(t), t.snapshot_docs, t.documents.where("doc_id % 4 = 0"))


def _live(t):
    """Tables that a rollback touches: bases 0 to 9 go back, one of these is being vectorised."""
    kb = t.docs.select("doc_id", "kb_id")
    settings = ["CAST(500 + creator_id AS INT) AS chunk_size", "CAST(NULL AS INT) AS chunk_overlap"]
    tables = {
        "docs": _current(t).join(kb, "doc_id").select("doc_id", "kb_id", "filename", "file_type", "content_hash", "chunk_count", "status"),
        "grants": t.grants.where("user_id % 2 = 0"),
        "kbs": t.kbs.selectExpr("kb_id", "name", "CASE WHEN creator_id = 4 THEN 'vectorizing' ELSE status END AS status", *settings),
        "index_versions": t.index_versions.selectExpr("kb_id", "CAST(version AS STRING) AS version", "status", "1L AS chunk_count"),
        "version_docs": t.docs.selectExpr("kb_id", "'v1' AS version", "doc_id"),
        "snapshots": t.snapshots.selectExpr("CAST(snapshot_id AS STRING) AS snapshot_id", "kb_id", "'manual' AS trigger"),
    }
    tables["snapshot_docs"] = tables["docs"].select(F.lit("s1").alias("snapshot_id"), "*").where("doc_id % 2 = 0")
    config = t.kbs.where("creator_id < 10").selectExpr("kb_id", "concat(name, '!') AS name", "CAST(NULL AS INT) AS chunk_size", "50 AS chunk_overlap")
    return tables, t.snapshot_docs.join(kb, "doc_id"), config


def _rolled(t, name: str, whole: bool = True):
    """One table after the commit of all of them."""
    tables, snapshot, config = _live(t)
    store = TableSet(t.spark, new_path(t.spark, "rollback"))
    base = store.commit(tables, 0)
    chosen = None if whole else t.documents.where("doc_id % 4 = 0").select("doc_id")
    store.commit(V.rollback_tables(store.read(), snapshot, config, t.grants, "s1", "v2", chosen), base)
    return store.read()[name]


_FREE = "free AS (SELECT kb_id, creator_id FROM kbs WHERE creator_id < 10 AND creator_id <> 4)"
_ROLLED = f"{_FREE}, cur AS (SELECT c.doc_id, d.kb_id, c.filename, c.file_type, c.content_hash, c.chunk_count, d.status FROM current_docs AS c JOIN docs AS d ON d.doc_id = c.doc_id), snap AS (SELECT s.*, d.kb_id FROM snapshot_docs AS s JOIN docs AS d ON d.doc_id = s.doc_id WHERE d.kb_id IN (SELECT kb_id FROM free) AND CHOSEN), done AS (SELECT doc_id, kb_id, filename, file_type, content_hash, chunk_count, 'pending_segment' AS status FROM snap UNION ALL SELECT doc_id, kb_id, filename, file_type, content_hash, chunk_count, CASE WHEN kb_id IN (SELECT kb_id FROM free) THEN REST ELSE status END AS status FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM snap))"
_WHOLE, _PART = (_ROLLED.replace("CHOSEN", c).replace("REST", r) for c, r in (("TRUE", "'archived'"), ("s.doc_id % 4 = 0", "status")))


@query(f"WITH {_WHOLE} SELECT * FROM done")
def ver05_rollback_docs(t):
    return _rolled(t, "docs")


@query(f"WITH {_FREE} SELECT * FROM grants WHERE kb_id IN (SELECT kb_id FROM free) OR user_id % 2 = 0")
def ver05_rollback_grants(t):
    return _rolled(t, "grants")


@query(f"WITH {_FREE} SELECT k.kb_id, CASE WHEN f.kb_id IS NULL THEN k.name ELSE k.name || '!' END AS name, CASE WHEN f.kb_id IS NOT NULL OR k.creator_id = 4 THEN 'vectorizing' ELSE k.status END AS status, (500 + k.creator_id)::INT AS chunk_size, CASE WHEN f.kb_id IS NOT NULL THEN 50 END::INT AS chunk_overlap FROM kbs AS k LEFT JOIN free AS f ON f.kb_id = k.kb_id")
def ver05_rollback_rules(t):
    return _rolled(t, "kbs")


_VERSIONS = "SELECT kb_id, version::VARCHAR AS version, status, 1::BIGINT AS chunk_count FROM index_versions UNION ALL SELECT f.kb_id, 'v2' AS version, 'building' AS status, coalesce(sum(d.chunk_count), 0)::BIGINT AS chunk_count FROM free AS f LEFT JOIN done AS d ON d.kb_id = f.kb_id AND d.status <> 'archived' GROUP BY f.kb_id"


@query(f"WITH {_WHOLE} {_VERSIONS}")
def ver05_rollback_versions(t):
    return _rolled(t, "index_versions")


@query(f"WITH {_PART} SELECT kb_id, 'v1' AS version, doc_id FROM docs UNION ALL SELECT kb_id, 'v2' AS version, doc_id FROM done WHERE status <> 'archived' AND kb_id IN (SELECT kb_id FROM free)")
def ver05_rollback_part(t):
    return _rolled(t, "version_docs", False)


@query(f"WITH {_WHOLE} SELECT 's1' AS snapshot_id, * FROM cur WHERE doc_id % 2 = 0 UNION ALL SELECT 's1-v2-protection' AS snapshot_id, * FROM cur WHERE kb_id IN (SELECT kb_id FROM free)")
def ver05_rollback_protection(t):
    return _rolled(t, "snapshot_docs")


@query(f"WITH src AS (SELECT d.doc_id, d.raw_text AS t FROM docs AS d WHERE d.doc_id IN (SELECT doc_id FROM snapshot_docs)), {Q.paragraphs('src')} SELECT doc_id, len(cs)::BIGINT AS n, list_sum(list_transform(cs, lambda c: length(c)))::BIGINT AS chars FROM cut WHERE len(cs) > 0")
def ver06_compensate(t):
    out = V.compensate(t.snapshot_docs, t.docs.select("doc_id", "raw_text"), "doc_id", "raw_text")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))


@query("WITH s AS (SELECT * FROM snapshots WHERE snapshot_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')), o AS (SELECT *, created_at < TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY AS old FROM s), y AS (SELECT snapshot_id, row_number() OVER (PARTITION BY kb_id ORDER BY created_at DESC, snapshot_id DESC) AS n FROM o WHERE NOT old AND NOT is_protection) SELECT snapshot_id, 'age' AS reason FROM o WHERE old UNION ALL SELECT snapshot_id, 'count' AS reason FROM y WHERE n > 50")
def ver07_prune_snapshots(t):
    out = t.snapshots.where("event_type = 'click'").select("snapshot_id")
    return V.prune_snapshots(t.snapshots, "2024-04-10 00:00:00", excluded=out)


@query("WITH c AS (SELECT kb_id, max(version) AS v FROM index_versions WHERE kb_id <> 'src3' GROUP BY kb_id), o AS (SELECT c.kb_id, c.v FROM c JOIN index_versions AS i ON i.kb_id = c.kb_id AND i.version = c.v AND i.status <> 'failed') SELECT i.kb_id, i.version, CASE WHEN o.v IS NULL THEN i.status WHEN i.version = o.v THEN 'current' WHEN i.status = 'current' THEN 'obsolete' ELSE i.status END AS status FROM index_versions AS i LEFT JOIN o ON o.kb_id = i.kb_id")
def ver08_activate(t):
    chosen = t.index_versions.where("kb_id <> 'src3'").groupBy("kb_id").agg(F.max("version").alias("version"))
    return V.activate(t.index_versions, chosen)


@query("SELECT d.doc_id, d.kb_id, coalesce(CASE WHEN k.creator_id % 2 = 0 THEN 800 END, 500)::INT AS chunk_size, 50::INT AS chunk_overlap, CASE WHEN d.file_type = 'md' THEN 'markdown' ELSE 'paragraph' END AS split_mode FROM docs AS d JOIN kbs AS k ON k.kb_id = d.kb_id WHERE d.status IN ('ready', 'error')")
def ver09_plan_revectorize(t):
    none = lambda n, k: F.lit(None).cast(k).alias(n)
    docs = t.docs.select("doc_id", "kb_id", "file_type", "status", none("chunk_size", "int"), none("chunk_overlap", "int"), none("split_mode", "string"))
    rules = t.kbs.select("kb_id", F.when(F.col("creator_id") % 2 == 0, 800).alias("chunk_size"), none("chunk_overlap", "int"), none("split_mode", "string"))
    return V.plan_revectorize(docs, rules)


@query("SELECT doc_id, CASE WHEN status = 'error' THEN 'error' ELSE 'no_chunks' END AS reason FROM docs WHERE status = 'error' OR doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id % 6 <> 0)")
def ver10_plan_rebuild(t):
    return V.plan_rebuild(t.docs, t.chunks.where("doc_id % 6 <> 0"))


@query("SELECT kb_id, arg_max(task_id, (updated_at, task_id)) AS task_id, arg_max(status, (updated_at, task_id)) AS status, bool_or(status IN ('pending', 'queued', 'running')) AS active, floor(100 * count(*) FILTER (WHERE status NOT IN ('pending', 'queued', 'running')) / count(*))::BIGINT AS percent FROM tasks GROUP BY kb_id")
def ver11_latest_task(t):
    return V.latest_task(t.tasks)


_EDGES = ", ".join(f"('{a}', '{b}')" for a, to in V.STEPS.items() for b in to)


@query(f"WITH e(a, b) AS (VALUES {_EDGES}), l AS (SELECT document_id, seq, status, lag(status) OVER (PARTITION BY document_id ORDER BY seq) AS before FROM status_log) SELECT document_id, seq, before, status FROM l WHERE before IS NOT NULL AND (before, status) NOT IN (SELECT a, b FROM e)")
def ver12_illegal_transitions(t):
    return V.illegal_transitions(t.status_log)


@query("SELECT document_id, seq, status, CASE WHEN status = 'error' THEN 'm' || seq::VARCHAR END AS error_message FROM status_log")
def ver12_error_messages(t):
    return V.error_messages(t.status_log.withColumn("error_message", F.concat(F.lit("m"), F.col("seq").cast("string"))))


_MODELS = "SELECT event_id AS model_id, event_type AS kind, event_id % 3 <> 0 AS enabled, event_id % 200 = 1 AS is_default, CAST(floor(value) AS BIGINT) AS priority FROM {events}"


@query(f"WITH m AS ({_MODELS.replace('{events}', 'events')}) SELECT kind, model_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY is_default DESC, priority DESC, model_id) AS n FROM m WHERE enabled) AS x WHERE n = 1")
def ver13_resolve_models(t):
    return V.resolve_models(t.spark.sql(_MODELS, events=t.events))


@query(f"WITH m AS ({_MODELS.replace('{events}', 'events')}) SELECT kind, count(*) AS n FROM m WHERE is_default GROUP BY kind HAVING count(*) > 1", name="ver13_default_conflicts")
def ver13_default_conflicts(t):
    return V.default_conflicts(t.spark.sql(_MODELS, events=t.events))


@query(f"""WITH d AS (SELECT doc_id, text AS x FROM documents WHERE doc_id % 9 <> 0 AND length(text) > 0), {Q.normal('d')}, src AS (SELECT doc_id, {Q.NORMAL_TEXT} AS t FROM nk), {Q.paragraphs('src')}
SELECT concat('d', f.doc_id, CASE WHEN f.doc_id % 9 = 0 THEN '.csv' ELSE '.txt' END) AS filename, CASE WHEN length(f.text) > 0 AND f.doc_id % 9 <> 0 THEN 'ready' ELSE 'error' END AS status, CASE WHEN length(f.text) = 0 THEN 'empty' WHEN f.doc_id % 9 = 0 THEN 'unsupported_type' END AS error, coalesce(len(cut.cs), 0)::BIGINT AS n_vectors FROM documents AS f LEFT JOIN cut ON cut.doc_id = f.doc_id""")
def ver14_build_corpus(t):
    files = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".csv").otherwise(".txt")).alias("filename"), F.length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    vectors, state = V.build_corpus(files)
    n = vectors.groupBy("filename").agg(F.count("*").alias("n_vectors"))
    return state.join(n, "filename", "left").select("filename", "status", "error", F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_vectors"))
