"""Conversations: lists, expiry, retention, context windows, summaries, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import title

#: Idle minutes, days and turns that history is kept, turns of context, characters of a message.
IDLE, DAYS, TURNS, CONTEXT, LONGEST = 30, 7, 20, 10, 2000


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    return df.offset((number - 1) * size).limit(size)


def session_list(sessions: DataFrame, used: DataFrame, kbs: DataFrame, user_id: int) -> DataFrame:
    """A user's sessions, the latest first, with the names of their bases in order. ``used(session_id, ord, kb_id)``."""
    names = used.join(kbs.select("kb_id", "name"), "kb_id").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    mine = sessions.where((F.col("user_id") == user_id) & (F.col("status") != "deleted")).join(names, "session_id", "left")
    return mine.select("session_id", F.coalesce(F.array_join("names", ","), F.lit("")).alias("kb_names"), "last_active_at").orderBy(F.desc("last_active_at"), "session_id")


def session_messages(messages: DataFrame, session_id: int) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("created_at", "message_id")


def admin_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """All sessions with a label and the type of their owner."""
    both = sessions.join(users.select("user_id", "nickname", "username"), "user_id", "left")
    label = F.when(F.col("user_id").isNotNull(), F.coalesce(F.nullif("nickname", F.lit("")), "username")).otherwise(F.concat(F.lit("guest "), F.substring("guest_id", 1, 8)))
    return both.select("session_id", label.alias("owner"), F.when(F.col("user_id").isNotNull(), "user").otherwise("guest").alias("owner_type"))


def expire_idle(sessions: DataFrame, now: str, minutes: int = IDLE) -> DataFrame:
    idle = (F.col("status") == "active") & (F.col("last_active_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTE"))
    return sessions.select("session_id", F.when(idle, "expired").otherwise(F.col("status")).alias("status"))


def retain(sessions: DataFrame, messages: DataFrame, now: str, days: int = DAYS, most: int = 2 * TURNS) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages that stay.

    Sessions idle longer go with their messages, older messages of the rest go, each identity
    keeps its newest ``most`` messages over its sessions that are not deleted, touched sessions are
    recounted without summary, and those left empty go.
    """
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")
    live = sessions.where(F.col("last_active_at") >= since)
    identity = F.when(F.col("status") != "deleted", F.coalesce(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("g"), "guest_id")))
    rows = messages.where(F.col("created_at") >= since).join(live.select("session_id", identity.alias("identity")), "session_id")
    w = Window.partitionBy("identity").orderBy(F.desc("created_at"), F.desc("message_id"))
    kept = rows.where("identity IS NULL").drop("identity").unionByName(rows.where("identity IS NOT NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n", "identity"))
    counts = kept.groupBy("session_id").agg(F.count("*").alias("now"))
    out = live.join(counts, "session_id").select("session_id", "status", F.col("now").alias("message_count"), F.when(F.col("now") == F.col("message_count"), F.col("summary")).alias("summary"))
    return out, kept


def context_window(messages: DataFrame, turns: int = CONTEXT) -> DataFrame:
    """Messages with ``kept``: the last ``2 turns`` of each session, texts stripped and cut; the others go to the summary."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return messages.withColumn("n", F.row_number().over(w)).select("session_id", "message_id", "role", "created_at", F.substring(F.trim("content"), 1, LONGEST).alias("content"), (F.col("n") <= 2 * turns).alias("kept"))


def fold_turns(turns: DataFrame) -> DataFrame:
    """Per session: two messages a turn, last activity, title from the first question, bases of the last turn."""
    at = F.struct("created_at", "request_id")
    return turns.groupBy("session_id").agg((2 * F.count("*")).alias("message_count"), F.max("created_at").alias("last_active_at"), title(F.min_by("question", at)).alias("title"), F.max_by("kb_id", at).alias("kb_id"))


def fallback_summary(overflow: DataFrame, before: DataFrame, longest: int = 400) -> DataFrame:
    """The earlier summary and the role-labelled lines of what left the window, the first ``longest`` characters of these."""
    line = F.struct("created_at", "message_id", F.concat("role", F.lit(": "), "content").alias("line"))
    text = overflow.groupBy("session_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 1, longest).alias("text"))
    return text.join(before, "session_id", "left").select("session_id", F.concat_ws("\n", F.nullif("summary", F.lit("")), "text").alias("summary"))


def merge_feedback(messages: DataFrame, sessions: DataFrame, feedback: DataFrame) -> DataFrame:
    """The latest rating per message by the session's owner."""
    own = feedback.join(messages.select("message_id", "session_id"), ["message_id", "session_id"]).join(sessions.select("session_id", F.col("user_id").alias("owner")), "session_id").where("owner = user_id")
    last = own.groupBy("message_id").agg(F.max_by("rating", F.struct("ts", "feedback_id")).alias("rating"))
    return messages.select("message_id").join(last, "message_id", "left")


def search_audit(logs: DataFrame, users: DataFrame, action: str | None = None, user_id: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Log rows that meet all given predicates, with the user's name, newest first."""
    out = logs
    if action:
        out = out.where(F.startswith(F.lower("action"), F.lit(action.lower())))
    if user_id is not None:
        out = out.where(F.col("user_id") == user_id)
    if since:
        out = out.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return out.join(users.select("user_id", F.col("username").alias("name")), "user_id", "left").orderBy(F.desc("ts"), F.desc("event_id"))


def search_users(users: DataFrame, keyword: str, role: str | None = None) -> DataFrame:
    like = F.lit(keyword.lower())
    out = users.where(F.contains(F.lower("username"), like) | F.contains(F.lower("department"), like) | F.contains(F.lower("role_name"), like))
    return out if role is None else out.where(F.col("role_name") == role)
