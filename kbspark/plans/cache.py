"""Queries of the question cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions.text import question_key
from kbspark.operators import cache as C
from kbspark.plans.registry import query
from kbspark.sources.standins import AS_OF

_KEY = "regexp_replace(regexp_replace(lower(trim(question)), '\\s+', ' ', 'g'), '[?!.,;: ]+$', '')"


def _log(t):
    """The question log as messages: a question and, for two of three, an answer of the same request."""
    q = t.question_log.selectExpr("event_id * 2 AS message_id", "user_id AS session_id", "'user' AS role", "question AS content", "CAST(event_id AS STRING) AS request_id", "ts AS created_at")
    a = t.question_log.where("event_id % 3 <> 0").selectExpr("event_id * 2 + 1 AS message_id", "user_id AS session_id", "'assistant' AS role", "concat('A', event_id) AS content", "CAST(event_id AS STRING) AS request_id", "ts AS created_at")
    return q.unionByName(a), t.users.selectExpr("user_id AS session_id", "user_id", "CASE WHEN user_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status")


@query(f"""WITH a AS (SELECT u.role AS for_role, {_KEY} AS key, q.event_id, q.ts, q.question FROM question_log AS q JOIN (SELECT DISTINCT user_id, role FROM user_roles) AS u ON u.user_id = q.user_id WHERE q.user_id % 17 <> 0 AND q.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
g AS (SELECT for_role, key, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last, max(ts) AS seen, arg_max(question, (ts, event_id)) AS question FROM a WHERE NOT contains(key, 'about 7') GROUP BY for_role, key),
w AS (SELECT *, row_number() OVER (PARTITION BY for_role ORDER BY n DESC, seen DESC, last DESC, key) AS place FROM g),
f AS (SELECT * FROM w WHERE place <= 15 AND last % 3 <> 0)
SELECT for_role, key, n, rank, question, 'A' || last::VARCHAR AS answer, last::VARCHAR AS request_id FROM (SELECT *, row_number() OVER (PARTITION BY for_role ORDER BY place)::INT AS rank FROM f) AS x WHERE rank <= 5""")
def cache01_mine_history(t):
    messages, sessions = _log(t)
    cached = t.question_log.select(question_key("question").alias("key")).distinct().where("contains(key, 'about 7')").withColumn("__k", F.lit(1)).join(t.user_roles.select("role").distinct().withColumn("__k", F.lit(1)), "__k").drop("__k")
    return C.mine_history(messages, sessions, t.user_roles, cached, AS_OF)


def _entries(t):
    q = t.question_log.where("event_id % 5 = 0")
    return q.select("event_id", F.col("event_id").alias("entry_id"), F.lit("staff").alias("role"), question_key("question").alias("key"), (F.col("event_id") % 3 != 0).alias("enabled"), F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), (F.col("event_id") % 6).cast("string")))).alias("source_kbs"), F.col("ts").alias("updated_at"), F.lit(0).alias("hits"))


_LOOK = f"""e AS (SELECT event_id AS entry_id, {_KEY} AS key, concat('src', event_id % 6) AS src, ts FROM question_log WHERE event_id % 5 = 0 AND event_id % 3 <> 0 AND event_id % 4 <> 0),
q AS (SELECT event_id AS question_id, user_id, {_KEY} AS key FROM question_log), s AS (SELECT user_id, kb_id FROM grants),
m AS (SELECT q.question_id, arg_max(e.entry_id, (e.ts, e.entry_id)) AS entry_id FROM q JOIN e ON e.key = q.key JOIN s ON s.user_id = q.user_id AND s.kb_id = e.src GROUP BY q.question_id)"""


def _found(t):
    q = t.question_log.select(F.col("event_id").alias("question_id"), F.lit("staff").alias("role"), "user_id", "question")
    scope = t.grants.groupBy("user_id").agg(F.collect_set("kb_id").alias("kbs"))
    return C.lookup(q, _entries(t).drop("event_id"), scope)


@query(f"WITH {_LOOK} SELECT * FROM m")
def cache02_lookup(t):
    return _found(t)


@query(f"WITH {_LOOK} SELECT x.event_id AS entry_id, (SELECT count(*) FROM m WHERE m.entry_id = x.event_id) AS hits FROM question_log AS x WHERE x.event_id % 5 = 0", name="cache02_hit_counts")
def cache02_hit_counts(t):
    return C.hit_counts(_found(t), _entries(t))


@query("""WITH c AS (SELECT role_name AS role, username AS key, 'old' AS answer, CASE WHEN user_id % 2 = 0 THEN 'document' ELSE 'manual' END AS source FROM users), i AS (SELECT role_name AS role, username AS key, 'new' AS answer FROM users WHERE user_id % 3 = 0 UNION ALL SELECT 'staff' AS role, concat('x', user_id) AS key, 'new' AS answer FROM users WHERE user_id % 5 = 0)
SELECT c.role, c.key, coalesce(i.answer, c.answer) AS answer, c.source FROM c LEFT JOIN i ON i.role = c.role AND i.key = c.key WHERE c.source = 'manual' UNION ALL SELECT i.role, i.key, i.answer, 'document' AS source FROM i LEFT JOIN c ON c.role = i.role AND c.key = i.key AND c.source = 'manual' WHERE c.key IS NULL""")
def cache03_replace_generated(t):
    cache = t.users.selectExpr("role_name AS role", "username AS key", "'old' AS answer", "CASE WHEN user_id % 2 = 0 THEN 'document' ELSE 'manual' END AS source")
    items = t.users.where("user_id % 3 = 0").selectExpr("role_name AS role", "username AS key", "'new' AS answer").unionByName(t.users.where("user_id % 5 = 0").selectExpr("'staff' AS role", "concat('x', user_id) AS key", "'new' AS answer"))
    return C.replace_generated(cache, items)


@query(f"WITH c AS (SELECT username AS role, user_id % 3 + 1 AS days, user_id % 4 <> 0 AS enabled, CASE WHEN user_id % 5 <> 0 THEN TIMESTAMP '{AS_OF}' - (user_id % 6) * INTERVAL 1 DAY END AS d, CASE WHEN user_id % 7 <> 0 THEN TIMESTAMP '{AS_OF}' - (user_id % 4) * INTERVAL 1 DAY END AS h FROM users) SELECT role, 'documents' AS kind FROM c WHERE enabled AND (d IS NULL OR d <= TIMESTAMP '{AS_OF}' - days * INTERVAL 1 DAY) UNION ALL SELECT role, 'history' AS kind FROM c WHERE enabled AND (h IS NULL OR h <= TIMESTAMP '{AS_OF}' - days * INTERVAL 1 DAY)")
def cache04_due_jobs(t):
    ago = lambda n: f"TIMESTAMP '{AS_OF}' - make_dt_interval(CAST(user_id % {n} AS INT))"
    c = t.users.selectExpr("username AS role", "CAST(user_id % 3 + 1 AS INT) AS interval_days", "user_id % 4 <> 0 AS enabled", f"CASE WHEN user_id % 5 <> 0 THEN {ago(6)} END AS last_documents", f"CASE WHEN user_id % 7 <> 0 THEN {ago(4)} END AS last_history")
    return C.due_jobs(c, AS_OF)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'src1,src2' WHEN 1 THEN concat('src', user_id % 9) ELSE '' END AS kbs FROM events")
def cache05_source_kbs(t):
    meta = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"kb_ids":["src1","bad","src2","src1"]}' WHEN 1 THEN concat('{"kb_ids":[],"cached":{"kb_ids":["src', user_id % 9, '"]}}') ELSE '{}' END""")
    return t.events.select("event_id", F.array_join(C.source_kbs(meta), ",").alias("kbs"))


@query("SELECT username AS role, CASE WHEN user_id % 3 = 0 THEN 3 ELSE 7 END::INT AS interval_days FROM users")
def cache06_ensure_configs(t):
    return C.ensure_configs(t.users.where("user_id % 3 = 0").selectExpr("username AS role", "3 AS interval_days"), t.users.selectExpr("username AS role"))
