"""Knowledge-base tables derived from the driver's tables, each by one SELECT that both engines run.

``HASH(x)`` and ``TS(seconds)`` are spelt for each engine by ``spell``; ``{name}`` is another table.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

STANDINS = {
    "kbs": """SELECT source AS kb_id, concat('Base ', n) AS name, CASE n % 4 WHEN 0 THEN 'GUEST' WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS department,
        CASE WHEN n % 10 = 9 THEN 'archived' ELSE 'active' END AS status, CASE WHEN n % 10 = 8 THEN NULL ELSE 'v1' END AS current_index_version, n AS creator_id
        FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS BIGINT) AS n FROM {documents}) AS s""",
    "docs": """SELECT doc_id, source AS kb_id, concat('Doc', doc_id, '.', CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'pdf' END) AS filename,
        CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'pdf' END AS file_type,
        CASE WHEN doc_id % 77 = 0 THEN 'archived' WHEN doc_id % 50 = 0 THEN 'error' ELSE 'ready' END AS status, text AS raw_text, n_chars FROM {documents}""",
    "users": """SELECT user_id, concat('user', user_id) AS username, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b ' END AS department,
        CASE WHEN user_id % 10 = 0 THEN 'admin' WHEN user_id % 5 = 0 THEN 'guest' ELSE 'staff' END AS role_name FROM (SELECT DISTINCT user_id FROM {events}) AS u""",
    "grants": """SELECT k.kb_id, u.user_id, 'kb:read' AS permission_code FROM {kbs} AS k JOIN {users} AS u ON u.user_id % 13 = (2 * (13 - k.creator_id % 13)) % 13""",
    "messages": """SELECT conv_id * 100 + turn AS message_id, conv_id AS session_id, role, text AS content,
        concat(conv_id, '-', sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)) AS request_id,
        TS(1704067200 + (conv_id % 30) * 86400 + turn * 60) AS created_at FROM {conversations}""",
    "sessions": """SELECT session_id, CASE WHEN session_id % 20 = 0 THEN NULL ELSE session_id % 15 END AS user_id, CASE WHEN session_id % 20 = 0 THEN concat('guest-', session_id) END AS guest_id,
        CASE WHEN session_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status, max(created_at) AS last_active_at, count(*) AS message_count FROM {messages} GROUP BY session_id""",
    "question_log": """SELECT event_id, user_id, ts, concat(upper(event_type), '  about ', regexp_extract(props, '[0-9]+', 0), CASE WHEN event_id % 2 = 0 THEN '?' ELSE '' END) AS question FROM {events}""",
    "requests": """SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, concat('/api/v1/', event_type, '/', event_id) AS path,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS latency_s, user_id FROM {events}""",
    "tasks": """SELECT event_id AS task_id, concat('src', user_id % 20) AS kb_id, ts AS updated_at,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'queued' END AS status FROM {events}""",
    "usage": """SELECT event_type AS model, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS output_tokens,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) + 1 END AS total_tokens, value / 1000 AS cost FROM {events}""",
    "questions": """SELECT item_id AS question_id, text AS question, text AS passage FROM {benchmark}""",
    "vectors": """SELECT vec_id AS chunk_id, concat('src', label) AS kb_id, 'v1' AS index_version, embedding, label FROM {embeddings}""",
    "snapshot_docs": """SELECT doc_id, filename, file_type, HASH(CASE WHEN doc_id % 7 = 0 THEN concat(raw_text, 'x') ELSE raw_text END) AS content_hash, CAST(doc_id % 5 AS BIGINT) AS chunk_count FROM {docs} WHERE doc_id % 10 <> 0""",
    "current_docs": """SELECT doc_id, filename, file_type, HASH(raw_text) AS content_hash, CAST(doc_id % 5 AS BIGINT) AS chunk_count FROM {docs} WHERE doc_id % 11 <> 0""",
    "chunks": """SELECT doc_id * 1000 + i AS chunk_id, doc_id, kb_id, CAST(i AS BIGINT) AS chunk_index, substring(raw_text, CAST(i * 450 + 1 AS INT), 500) AS content, (doc_id + i) % 9 <> 0 AS is_enabled
        FROM (SELECT doc_id, kb_id, raw_text, i FROM {docs} EACH(i, greatest(ceil((length(raw_text) - 500) / 450.0), 0))) AS x""",
    "user_roles": """SELECT user_id, role_name AS role FROM {users} UNION ALL SELECT user_id, 'kb_admin' AS role FROM {users} WHERE user_id % 7 = 0 UNION ALL SELECT user_id, 'super_admin' AS role FROM {users} WHERE user_id % 25 = 1""",
    "snapshots": """SELECT event_id AS snapshot_id, concat('src', user_id % 20) AS kb_id, ts AS created_at, event_id % 6 = 0 AS is_protection, event_type FROM {events}""",
    "index_versions": """SELECT concat('src', user_id % 20) AS kb_id, event_id AS version, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'current' WHEN 'click' THEN 'building' ELSE 'ready' END AS status FROM {events}""",
    "status_log": """SELECT user_id AS document_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ready' ELSE 'vectorizing' END AS status FROM {events}""",
    "runs": """SELECT event_id AS run_id, ts AS started_at, concat('src', user_id % 20) AS kb_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CAST(floor(value) AS BIGINT) + 1 AS total_questions, CAST(floor(value / 2) AS BIGINT) AS hit_count FROM {events}""",
    "answers": """SELECT conv_id * 100 + turn AS message_id, conv_id AS run_id, text AS response, length(text) AS latency_ms FROM {conversations} WHERE role = 'assistant'""",
}


def _macro(sql: str, name: str, spell) -> str:
    """Replace ``name(argument)``, parentheses in balance."""
    while (m := re.search(rf"\b{name}\(", sql)) is not None:
        at, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = sql[: m.start()] + spell(sql[m.end() : at - 1]) + sql[at:]
    return sql


def spell(sql: str, engine: str) -> str:
    """The SQL of ``spark`` or ``duckdb``."""
    spark = engine == "spark"
    sql = _macro(sql, "HASH", lambda x: f"sha2({x}, 256)" if spark else f"sha256({x})")
    sql = _macro(sql, "TS", lambda x: f"timestamp_seconds({x})" if spark else f"make_timestamp(CAST(({x}) AS BIGINT) * 1000000)")

    def each(x: str) -> str:
        name, last = x.split(",", 1)
        return f"LATERAL VIEW explode(sequence(0L, CAST({last} AS BIGINT))) e AS {name}" if spark else f", LATERAL (SELECT unnest(range(CAST({last} AS BIGINT) + 1)) AS {name}) AS e"

    return _macro(sql, "EACH", each)


@cache
def _needs(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", STANDINS[name])))


class Tables:
    """The tables of a folder by name, given and derived."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE and name not in STANDINS:
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.spark.sql(spell(STANDINS[name], "spark"), **{n: getattr(self, n) for n in _needs(name)})
        return self._made[name]


def with_standins(sql: str) -> str:
    """DuckDB SQL that defines the derived tables which ``sql`` names, before its own common tables."""
    found: list[str] = []

    def add(name: str) -> None:
        for need in _needs(name):
            if need in STANDINS:
                add(need)
        if name not in found:
            found.append(name)

    for name in STANDINS:
        if re.search(rf"(?<![\w.']){name}(?![\w.(])", sql):
            add(name)
    body = spell(sql.strip(), "duckdb")
    if not found:
        return body
    made = ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', spell(STANDINS[n], 'duckdb'))})" for n in found)
    return f"WITH {made},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {made}\n{body}"
