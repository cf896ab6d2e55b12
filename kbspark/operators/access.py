"""Entitlements: who may see, use and manage what. Equi-joins only; unions of joins in place of OR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import department

#: Ranks of roles; an unknown role has 5.
RANKS = {"super_admin": 100, "admin": 50, "staff": 20, "kb_admin": 20, "guest": 10, "user": 10}


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame, roles: DataFrame) -> DataFrame:
    """``user_id, codes``: distinct permission codes of enabled roles, sorted."""
    on = roles.where("is_enabled").select("role")
    return user_roles.join(on, "role").join(role_permissions, "role").groupBy("user_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def role_rank(c: str | Column) -> Column:
    ranks = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(ranks[F.col(c) if isinstance(c, str) else c], F.lit(5))


def user_ranks(users: DataFrame, user_roles: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``user_id, rank``: the highest of a user's roles, 0 without any; of the enabled ones if ``roles(role, is_enabled)`` is given."""
    held = user_roles if roles is None else user_roles.join(roles.where("is_enabled").select("role"), "role", "left_semi")
    best = held.groupBy("user_id").agg(F.max(role_rank("role")).alias("rank"))
    return users.select("user_id").join(best, "user_id", "left").select("user_id", F.coalesce("rank", F.lit(0)).alias("rank"))


def visible_kbs(users: DataFrame, kbs: DataFrame, grants: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """``user_id, kb_id`` of active bases with a version.

    Guests see the GUEST department, admins all, others also their department, what they made,
    and what is granted to them. Users and bases meet on keys; the pairs of all admins with all
    bases and of all users with the open ones are the result itself.
    """
    live = kbs.where("status = 'active' AND trim(current_index_version) <> ''").select("kb_id", department("department").alias("dept"), "creator_id")
    who = users.select("user_id", "role_name", department("department").alias("dept"))
    staff = who.where("role_name <> 'guest'")
    one = lambda df: df.withColumn("__k", F.lit(1))
    everyone = one(who).join(one(live.where("dept = 'GUEST'")).select("__k", "kb_id"), "__k").select("user_id", "kb_id")
    admins = one(who.where("role_name = 'admin'")).join(one(live).select("__k", "kb_id"), "__k").select("user_id", "kb_id")
    own = staff.join(live.select("dept", "kb_id"), "dept").select("user_id", "kb_id")
    made = staff.join(live.select(F.col("creator_id").alias("user_id"), "kb_id"), "user_id").select("user_id", "kb_id")
    given = grants.select("user_id", "kb_id").join(staff.select("user_id"), "user_id").join(live.select("kb_id"), "kb_id").select("user_id", "kb_id")
    out = everyone.unionByName(admins).unionByName(own).unionByName(made).unionByName(given).distinct()
    return out if requested is None else out.join(requested.select("kb_id").distinct(), "kb_id", "left_semi")


def access_matrix(asked: DataFrame, users: DataFrame, kbs: DataFrame, grants: DataFrame, global_codes: DataFrame) -> DataFrame:
    """``user_id, kb_id, permission, allowed, reason`` for each question of ``asked``, by the first rule that holds."""
    u = users.select("user_id", "role_name", department("department").alias("ud"))
    k = kbs.where("status <> 'deleted'").select("kb_id", department("department").alias("kd"), "creator_id")
    g = grants.select("user_id", "kb_id", "permission_code").distinct()
    exact = g.select("user_id", "kb_id", F.col("permission_code").alias("permission"), F.lit(True).alias("exact"))
    over = g.where("permission_code = 'kb:admin'").select("user_id", "kb_id", F.lit(True).alias("over"))
    c = global_codes.select("user_id", F.col("code").alias("permission"), F.lit(True).alias("broad")).distinct()
    r = asked.join(u, "user_id").join(k, "kb_id", "left").join(exact, ["user_id", "kb_id", "permission"], "left").join(over, ["user_id", "kb_id"], "left").join(c, ["user_id", "permission"], "left")
    reason = (
        F.when(F.col("creator_id").isNull(), "not_found")
        .when(F.col("role_name") == "admin", "admin")
        .when(F.col("creator_id") == F.col("user_id"), "creator")
        .when(F.col("exact") | F.col("over"), "granted")
        .when(F.col("broad").isNull(), "denied")
        .when(F.col("kd") == "GUEST", "open")
        .when(F.col("ud").isNotNull() & F.col("kd").isNotNull() & (F.col("ud") != F.col("kd")), "department")
        .otherwise("global")
    )
    return r.withColumn("reason", reason).select("user_id", "kb_id", "permission", (~F.col("reason").isin("not_found", "denied", "department")).alias("allowed"), "reason")


def list_kbs(visible: DataFrame, kbs: DataFrame, user_id: int, keyword: str = "", page: int = 1, size: int = 20) -> DataFrame:
    mine = kbs.join(visible.where(F.col("user_id") == user_id).select("kb_id"), "kb_id", "left_semi").where(F.contains(F.lower("name"), F.lit(keyword.lower())))
    return mine.orderBy(F.desc("creator_id"), "kb_id").offset((page - 1) * size).limit(size)


def role_kbs(roles: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """``role, kb_id`` that a role may be analysed on: open or granted ones, all for admins."""
    live = kbs.where("status = 'active'")
    one = lambda df: df.withColumn("__k", F.lit(1))
    open_ = one(roles).join(one(live.where(department("department") == "GUEST").select("kb_id")), "__k").select("role", "kb_id")
    every = one(roles.where(F.col("role").isin("admin", "super_admin"))).join(one(live.select("kb_id")), "__k").select("role", "kb_id")
    given = grants.select("role", "kb_id").join(live.select("kb_id"), "kb_id", "left_semi").join(roles, "role", "left_semi").select("role", "kb_id")
    return open_.unionByName(every).unionByName(given).distinct()


def manageable(ranks: DataFrame) -> DataFrame:
    """``user_id, n_below``: how many users rank strictly lower; by the few rank levels, not by pairs of users."""
    levels = ranks.groupBy("rank").agg(F.count("*").alias("n"))
    below = levels.alias("a").join(F.broadcast(levels).alias("b"), F.col("b.rank") < F.col("a.rank"), "left").groupBy(F.col("a.rank").alias("rank")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("n_below"))
    return ranks.join(below, "rank").select("user_id", "n_below")


def repair_super_admins(user_roles: DataFrame, keeper: int) -> DataFrame:
    """Nobody but ``keeper`` stays super_admin; others become admin."""
    bad = (F.col("role") == "super_admin") & (F.col("user_id") != keeper)
    return user_roles.select("user_id", F.when(bad, "admin").otherwise(F.col("role")).alias("role")).distinct()


def migrate_roles(user_roles: DataFrame) -> DataFrame:
    """Old role names: user becomes guest, kb_admin becomes staff."""
    new = F.when(F.col("role") == "user", "guest").when(F.col("role") == "kb_admin", "staff").otherwise(F.col("role"))
    return user_roles.select("user_id", new.alias("role")).distinct()


def repair_visibility(kbs: DataFrame) -> DataFrame:
    """Public bases join GUEST, all others are restricted."""
    public = F.col("visibility") == "public"
    return kbs.select("kb_id", F.when(public, "GUEST").otherwise(department("department")).alias("department"), F.when(public | department("department").eqNullSafe(F.lit("GUEST")), "public").otherwise("restricted").alias("visibility"))


def rename_department(df: DataFrame, old: str, new: str | None) -> DataFrame:
    """The rows with a department renamed, or cleared when ``new`` is null."""
    return df.withColumn("department", F.when(department("department") == old, F.lit(new)).otherwise(F.col("department")))


def drop_department(df: DataFrame, old: str) -> DataFrame:
    """The rows with a department taken away, and restricted where they have a visibility; that of guests stays."""
    if old == "GUEST":
        raise ValueError("the department of guests can't be dropped")
    hit = F.coalesce(department("department") == old, F.lit(False))
    out = df.withColumn("__hit", hit)
    if "visibility" in df.columns:
        out = out.withColumn("visibility", F.when(F.col("__hit"), "restricted").otherwise(F.col("visibility")))
    return out.withColumn("department", F.when(~F.col("__hit"), F.col("department"))).drop("__hit")


def assign_department(users: DataFrame, edits: DataFrame) -> DataFrame:
    """Users with ``edits(user_id, new_department)`` applied, or as they were if any id of the batch is unknown."""
    missing = edits.join(users.select("user_id"), "user_id", "left_anti").agg((F.count("*") == 0).alias("ok")).withColumn("__k", F.lit(1))
    both = users.join(edits.withColumn("hit", F.lit(True)), "user_id", "left").withColumn("__k", F.lit(1)).join(F.broadcast(missing), "__k")
    return both.select("user_id", F.when(F.col("ok") & F.col("hit"), F.col("new_department")).otherwise(F.col("department")).alias("department"))
