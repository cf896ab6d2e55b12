"""Queries of counts, trends and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import trends as A
from kbspark.plans.registry import query
from kbspark.sources.standins import AS_OF

_D = f"TIMESTAMP '{AS_OF}'"


@query("WITH d AS (SELECT DISTINCT department AS code FROM kbs WHERE department IS NOT NULL) SELECT code, (SELECT count(*) FROM users WHERE upper(trim(department)) = code) AS members, (SELECT count(*) FROM kbs WHERE department = code AND status <> 'archived') AS kbs FROM d")
def agg01_department_counts(t):
    return A.department_counts(t.kbs.where("department IS NOT NULL").select(F.col("department").alias("code")).distinct(), t.users, t.kbs)


@query("SELECT kb_id, count(*) AS n_docs, sum(doc_id % 9)::BIGINT AS n_chunks FROM docs WHERE status <> 'archived' GROUP BY kb_id")
def agg02_kb_totals(t):
    return A.kb_totals(t.docs.withColumn("chunk_count", F.col("doc_id") % 9))


@query("SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM kbs) AS kbs, (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM tasks WHERE status IN ('pending', 'queued', 'running')) AS queued, (SELECT count(*) FROM sessions WHERE status = 'active') AS active_sessions")
def agg03_platform_stats(t):
    return A.platform_stats(t.users, t.kbs, t.docs, t.tasks, t.sessions)


_DAYS = f"c AS (SELECT {_D} - i * INTERVAL 1 DAY AS slot FROM (SELECT unnest(range(40)) AS i) AS x)"


@query(f"WITH {_DAYS} SELECT strftime(c.slot, '%Y-%m-%d') AS day, count(m.message_id) AS n FROM c LEFT JOIN messages AS m ON date_trunc('day', m.created_at) = c.slot AND m.role = 'user' GROUP BY c.slot")
def agg04_qa_trend(t):
    return A.qa_trend(t.messages, AS_OF, 40)


@query(f"WITH {_DAYS} SELECT strftime(c.slot, '%Y-%m-%d') AS day, round(CASE WHEN sum(r.total_questions) > 0 THEN sum(r.hit_count) / sum(r.total_questions)::DOUBLE ELSE 0 END, 4)::DOUBLE AS hit_rate FROM c LEFT JOIN runs AS r ON date_trunc('day', r.started_at) = c.slot AND r.status = 'completed' GROUP BY c.slot")
def agg05_hit_rate_trend(t):
    return A.hit_rate_trend(t.runs, AS_OF, 40)


@query(f"WITH c AS (SELECT {_D} - i * INTERVAL 1 HOUR AS slot FROM (SELECT unnest(range(168)) AS i) AS x), e AS (SELECT date_trunc('hour', updated_at) AS slot FROM tasks WHERE status = 'failed' UNION ALL SELECT date_trunc('hour', ts) AS slot FROM requests WHERE status >= 500) SELECT strftime(c.slot, '%Y-%m-%d %H') AS hour, count(e.slot) AS n FROM c LEFT JOIN e ON e.slot = c.slot GROUP BY c.slot")
def agg06_error_hourly(t):
    return A.error_hourly([(t.tasks.where("status = 'failed'"), "updated_at"), (t.requests.where("status >= 500"), "ts")], AS_OF, 168)


@query(f"WITH c AS (SELECT {_D} - i * INTERVAL 1 HOUR AS slot, ((167 - i) * 28) // 168 AS bucket FROM (SELECT unnest(range(168)) AS i) AS x) SELECT c.bucket::INT AS bucket, count(t.task_id) AS n FROM c LEFT JOIN tasks AS t ON date_trunc('hour', t.updated_at) = c.slot AND t.status = 'failed' GROUP BY c.bucket")
def agg07_rebucket(t):
    return A.rebucket(A.error_hourly([(t.tasks.where("status = 'failed'"), "updated_at")], AS_OF, 168), "hour", "n", 168, 28)


@query(f"SELECT event_type AS reason, count(*) FILTER (WHERE ts <= {_D} AND ts > {_D} - INTERVAL 1 DAY) AS day, count(*) FILTER (WHERE ts <= {_D} AND ts > {_D} - INTERVAL 7 DAY) AS week FROM events GROUP BY event_type")
def agg08_guard_stats(t):
    return A.guard_stats(t.events.withColumns({"reason": F.col("event_type"), "label": F.lit(None).cast("string")}), AS_OF)[0]


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS label FROM events ORDER BY ts DESC, event_id DESC LIMIT 10", name="agg08_guard_latest")
def agg08_guard_latest(t):
    e = t.events.withColumns({"reason": F.col("event_type"), "label": F.when(F.col("event_type") != "view", F.col("event_type"))})
    return A.guard_stats(e, AS_OF)[1]


_USE = f"u AS (SELECT model, input_tokens, output_tokens, CASE WHEN coalesce(total_tokens, 0) > 0 THEN total_tokens ELSE input_tokens + output_tokens END AS total, cost FROM usage WHERE day > CAST({_D} AS DATE) - 20)"


@query(f"WITH {_USE} SELECT model, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total)::BIGINT AS total_tokens, round(sum(cost), 6) AS cost FROM u GROUP BY ROLLUP (model)")
def agg09_model_usage(t):
    return A.model_usage(t.usage, 20, AS_OF)


@query("SELECT model, string_agg(strftime(day, '%Y-%m-%d') || '=' || tokens::VARCHAR, ',' ORDER BY day) AS days FROM (SELECT model, day, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM usage GROUP BY model, day) AS x GROUP BY model", name="agg09_usage_daily")
def agg09_usage_daily(t):
    return A.usage_daily(t.usage).select("model", F.array_join(F.transform("days", lambda d: F.concat_ws("=", d["day"].cast("string"), d["tokens"].cast("string"))), ",").alias("days"))


@query("SELECT r.role, count(u.user_id) AS n FROM (SELECT DISTINCT role FROM user_roles) AS r LEFT JOIN users AS u ON u.role_name = r.role AND u.user_id % 2 = 0 GROUP BY r.role")
def agg10_cache_overview(t):
    return A.cache_overview(t.user_roles.select("role").distinct(), t.users.where("user_id % 2 = 0").withColumnRenamed("role_name", "role"))


@query("SELECT s.kb_id AS snapshot_id, CASE WHEN s.creator_id % 2 = 0 THEN count(d.doc_id) ELSE 7 END AS document_count, CASE WHEN s.creator_id % 3 = 0 THEN coalesce(sum(d.doc_id % 5), 0) ELSE 11 END::BIGINT AS total_chunks FROM kbs AS s LEFT JOIN docs AS d ON d.kb_id = s.kb_id GROUP BY s.kb_id, s.creator_id")
def agg11_repair_counters(t):
    snaps = t.kbs.selectExpr("kb_id AS snapshot_id", "CASE WHEN creator_id % 2 = 0 THEN 0 ELSE 7 END AS document_count", "CASE WHEN creator_id % 3 = 0 THEN 0 ELSE 11 END AS total_chunks")
    return A.repair_counters(snaps, t.docs.selectExpr("kb_id AS snapshot_id", "doc_id % 5 AS chunk_count"))


@query("SELECT method, regexp_replace(path, '/[0-9]+$', '/{id}') AS route, status, count(*) AS n, round(sum(latency_s), 6) AS seconds, round(max(latency_s), 6) AS slowest FROM requests GROUP BY ALL")
def agg12_http_rollup(t):
    return A.http_rollup(t.requests)


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in A.BOUNDS)
BUCKETS = f"b AS (SELECT * FROM (VALUES {_BOUNDS}, ('Infinity'::DOUBLE)) AS v(le))"
_HIST = f"{BUCKETS}, h AS (SELECT r.method, b.le, count(*) FILTER (WHERE r.latency_s <= b.le) AS cum FROM requests AS r CROSS JOIN b GROUP BY r.method, b.le)"


@query(f"WITH {_HIST} SELECT method, le, cum FROM h")
def agg13_histogram(t):
    return A.histogram(t.requests, "latency_s", ["method"])


@query(f"""WITH {_HIST}, w AS (SELECT method, le, cum, coalesce(lag(le) OVER (PARTITION BY method ORDER BY le), 0) AS low, coalesce(lag(cum) OVER (PARTITION BY method ORDER BY le), 0) AS before, max(cum) OVER (PARTITION BY method) AS n FROM h)
SELECT method, round(CASE WHEN le = 'Infinity' THEN low ELSE low + (le - low) * (n * 0.95 - before) / (cum - before) END, 6) AS value FROM w WHERE cum >= n * 0.95 AND before < n * 0.95""")
def agg14_histogram_quantile(t):
    return A.histogram_quantile(A.histogram(t.requests, "latency_s", ["method"]), 0.95, ["method"]).select("method", F.round("value", 6).alias("value"))


@query("SELECT epoch(w)::BIGINT AS start, method, round(count(*) / 300.0, 6)::DOUBLE AS rate FROM (SELECT method, date_trunc('minute', ts) - i * INTERVAL 1 MINUTE AS w FROM requests, LATERAL (SELECT unnest(range(5)) AS i) AS x) AS y GROUP BY w, method")
def agg15_rate(t):
    return A.rate(t.requests, "ts", ["method"]).select("start", "method", F.round("rate", 6).alias("rate"))


@query("SELECT user_id, round(avg(CASE WHEN status >= 500 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS ratio FROM requests GROUP BY user_id")
def agg16_error_rate(t):
    return A.error_rate(t.requests, ["user_id"]).select("user_id", F.round("ratio", 6).alias("ratio"))


@query("WITH s AS (SELECT 'guard' AS stage, value AS ms FROM events UNION ALL SELECT 'retrieval' AS stage, value * 2 AS ms FROM events UNION ALL SELECT 'answer' AS stage, value + 10 AS ms FROM events WHERE event_type <> 'error') SELECT stage, count(*) AS n, round(avg(ms), 4) AS mean, round(sum(ms) / (SELECT sum(ms) FROM s), 4) AS share FROM s GROUP BY stage")
def agg17_stage_latency(t):
    m = F.map_concat(F.create_map(F.lit("guard"), F.col("value"), F.lit("retrieval"), F.col("value") * 2), F.when(F.col("event_type") != "error", F.create_map(F.lit("answer"), F.col("value") + 10)).otherwise(F.create_map().cast("map<string,double>")))
    return A.stage_latency(t.events.select(m.alias("stages")))


@query("SELECT event_type AS step, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS result, count(*) AS n FROM events GROUP BY ALL")
def agg18_pipeline_steps(t):
    return A.pipeline_steps(t.events.selectExpr("event_type AS step", "CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS result"))
