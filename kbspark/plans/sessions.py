"""Queries of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions.text import title
from kbspark.operators import sessions as S
from kbspark.plans.registry import query
from kbspark.sources.standins import AS_OF


@query("SELECT s.session_id, k.name || ',' || l.name AS kb_names FROM sessions AS s JOIN kbs AS k ON k.creator_id = s.session_id % 20 JOIN kbs AS l ON l.creator_id = (s.session_id + 1) % 20 WHERE s.user_id = 4 AND s.status <> 'deleted' ORDER BY s.last_active_at DESC, s.session_id LIMIT 5")
def ses01_session_list(t):
    used = t.sessions.selectExpr("session_id", "0 AS ord", "concat('src', session_id % 20) AS kb_id").unionByName(t.sessions.selectExpr("session_id", "1 AS ord", "concat('src', (session_id + 1) % 20) AS kb_id"))
    return S.page(S.session_list(t.sessions, used, t.kbs, 4), 1, 5).select("session_id", "kb_names")


@query("SELECT message_id, role FROM messages WHERE session_id = 7 ORDER BY created_at, message_id LIMIT 3 OFFSET 3")
def ses02_messages(t):
    return S.page(S.session_messages(t.messages, 7), 2, 3).select("message_id", "role")


@query("SELECT s.session_id, CASE WHEN s.user_id IS NOT NULL THEN CASE WHEN s.user_id % 2 = 0 THEN 'Nick' || s.user_id::VARCHAR ELSE u.username END ELSE 'guest ' || substring(s.guest_id, 1, 8) END AS owner, CASE WHEN s.user_id IS NOT NULL THEN 'user' ELSE 'guest' END AS owner_type FROM sessions AS s LEFT JOIN users AS u ON u.user_id = s.user_id")
def ses03_admin_sessions(t):
    return S.admin_sessions(t.sessions, t.users.withColumn("nickname", F.expr("CASE WHEN user_id % 2 = 0 THEN concat('Nick', user_id) ELSE '' END")))


_NOW = "2024-01-20 00:00:00"


@query(f"SELECT session_id, CASE WHEN status = 'active' AND last_active_at < TIMESTAMP '{_NOW}' - INTERVAL 30 MINUTE THEN 'expired' ELSE status END AS status FROM sessions")
def ses04_expire_idle(t):
    return S.expire_idle(t.sessions, _NOW)


_RETAIN = f"""l AS (SELECT * FROM sessions WHERE last_active_at >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY),
r AS (SELECT m.session_id, m.message_id, m.created_at, CASE WHEN l.status <> 'deleted' THEN coalesce('u' || l.user_id::VARCHAR, 'g' || l.guest_id) END AS who FROM messages AS m JOIN l ON l.session_id = m.session_id WHERE m.created_at >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY),
k AS (SELECT session_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY created_at DESC, message_id DESC) AS n FROM r) AS x WHERE who IS NULL OR n <= 8)"""


def _retained(t):
    return S.retain(t.sessions.withColumn("summary", F.lit("s")), t.messages, _NOW, most=8)


@query(f"WITH {_RETAIN} SELECT l.session_id, l.status, count(*) AS message_count, CASE WHEN count(*) = any_value(l.message_count) THEN 's' END AS summary FROM l JOIN k ON k.session_id = l.session_id GROUP BY l.session_id, l.status")
def ses05_retention(t):
    return _retained(t)[0]


@query(f"WITH {_RETAIN} SELECT session_id, message_id FROM k", name="ses05_retained_messages")
def ses05_retained_messages(t):
    return _retained(t)[1].select("session_id", "message_id")


@query("SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) <= 4 AS kept, sha256(substring(trim(content), 1, 2000)) AS hash FROM messages")
def ses06_context_window(t):
    return S.context_window(t.messages, 2).select("session_id", "message_id", "kept", F.sha2("content", 256).alias("hash"))


@query("SELECT session_id, 2 * count(*) AS message_count, arg_min(CASE WHEN length(x) > 50 THEN substring(x, 1, 50) || '...' ELSE x END, message_id) AS title, arg_max(concat('src', message_id % 20), message_id) AS kb_id FROM (SELECT session_id, message_id, trim(replace(content, chr(10), ' ')) AS x FROM messages WHERE role = 'user') AS m GROUP BY session_id")
def ses07_fold_turns(t):
    turns = t.messages.where("role = 'user'").selectExpr("session_id", "created_at", "message_id AS request_id", "content AS question", "concat('src', message_id % 20) AS kb_id")
    return S.fold_turns(turns).drop("last_active_at")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS n FROM messages) SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'earlier' || chr(10) ELSE '' END || substring(string_agg(role || ': ' || substring(trim(content), 1, 2000), chr(10) ORDER BY created_at, message_id), 1, 400) AS summary FROM o WHERE n > 2 GROUP BY session_id")
def ses08_fallback_summary(t):
    over = S.context_window(t.messages, 1).where("NOT kept")
    return S.fallback_summary(over, t.sessions.select("session_id", F.when(F.col("session_id") % 2 == 0, "earlier").otherwise("").alias("summary")))


@query("WITH f AS (SELECT e.event_id, e.ts, m.message_id, e.event_type AS rating FROM events AS e JOIN messages AS m ON m.message_id = (e.event_id % 100) * 100 + e.event_id % 3 JOIN sessions AS s ON s.session_id = m.session_id AND s.user_id = e.user_id % 15), r AS (SELECT message_id, arg_max(rating, (ts, event_id)) AS rating FROM f GROUP BY message_id) SELECT m.message_id, r.rating FROM messages AS m LEFT JOIN r ON r.message_id = m.message_id")
def ses09_merge_feedback(t):
    f = t.events.selectExpr("event_id AS feedback_id", "ts", "user_id % 15 AS user_id", "event_type AS rating", "(event_id % 100) * 100 + event_id % 3 AS message_id", "event_id % 100 AS session_id")
    return S.merge_feedback(t.messages, t.sessions, f)


@query(f"SELECT e.event_id, u.username AS name FROM events AS e LEFT JOIN users AS u ON u.user_id = e.user_id WHERE starts_with(e.event_type, 'cl') AND e.ts >= TIMESTAMP '2024-01-05 00:00:00' AND e.ts <= TIMESTAMP '{AS_OF}' ORDER BY e.ts DESC, e.event_id DESC LIMIT 30 OFFSET 30")
def ses10_search_audit(t):
    logs = t.events.withColumn("action", F.upper("event_type"))
    return S.page(S.search_audit(logs, t.users, action="Cl", since="2024-01-05 00:00:00", until=AS_OF), 2, 30).select("event_id", "name")


@query("SELECT user_id, username FROM users WHERE contains(lower(username), '1') OR contains(lower(department), 'a') OR contains(role_name, '1a')")
def ses11_search_users(t):
    one, two = S.search_users(t.users, "1"), S.search_users(t.users, "A")
    return one.unionByName(two.where("department = 'A'")).select("user_id", "username").distinct()


@query("SELECT session_id, CASE WHEN length(x) > 50 THEN substring(x, 1, 50) || '...' ELSE x END AS title FROM (SELECT session_id, arg_min(trim(replace(content, chr(10), ' ')), message_id) AS x FROM messages GROUP BY session_id) AS y", name="txt23_session_title")
def txt23_session_title(t):
    return t.messages.groupBy("session_id").agg(title(F.min_by("content", "message_id")).alias("title"))
