"""Queries of entitlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import access as A
from kbspark.plans.registry import query

_ROLE_CODES = "SELECT DISTINCT u.role, concat('p', e.k) AS code FROM {ur} AS u JOIN (SELECT DISTINCT event_id % 9 AS k FROM {ev}) AS e ON length(u.role) % 3 = e.k % 3"


@query(f"""WITH rc AS ({_ROLE_CODES.format(ur='user_roles', ev='events')}) SELECT u.user_id, string_agg(DISTINCT rc.code, ',' ORDER BY rc.code) AS codes FROM user_roles AS u JOIN rc ON rc.role = u.role WHERE u.role <> 'guest' GROUP BY u.user_id""")
def acl01_effective_permissions(t):
    codes = t.spark.sql(_ROLE_CODES.replace("{ev}", "{events}").replace("{ur}", "{user_roles}"), user_roles=t.user_roles, events=t.events)
    roles = t.user_roles.select("role").distinct().withColumn("is_enabled", F.col("role") != "guest")
    return A.effective_permissions(t.user_roles, codes, roles).select("user_id", F.array_join("codes", ",").alias("codes"))


_RANK = "CASE role WHEN 'super_admin' THEN 100 WHEN 'admin' THEN 50 WHEN 'staff' THEN 20 WHEN 'kb_admin' THEN 20 WHEN 'guest' THEN 10 WHEN 'user' THEN 10 ELSE 5 END"


@query(f"SELECT user_id, coalesce(max(CASE WHEN role NOT IN ('kb_admin', 'guest') THEN {_RANK} END), 0)::INT AS rank FROM user_roles GROUP BY user_id")
def acl02_role_rank(t):
    roles = t.user_roles.select("role").distinct().withColumn("is_enabled", ~F.col("role").isin("kb_admin", "guest"))
    return A.user_ranks(t.users, t.user_roles, roles)


_VIS = """live AS (SELECT kb_id, upper(trim(department)) AS dept, creator_id FROM kbs WHERE status = 'active' AND current_index_version IS NOT NULL),
vis AS (SELECT u.user_id, k.kb_id FROM users AS u JOIN live AS k ON k.dept = 'GUEST' OR u.role_name = 'admin' OR (u.role_name <> 'guest' AND (k.dept = upper(trim(u.department)) OR k.creator_id = u.user_id OR EXISTS (SELECT 1 FROM grants AS g WHERE g.user_id = u.user_id AND g.kb_id = k.kb_id))))"""


@query(f"WITH {_VIS} SELECT * FROM vis")
def acl03_visible_kbs(t):
    return A.visible_kbs(t.users, t.kbs, t.grants)


@query(f"WITH {_VIS} SELECT * FROM vis WHERE kb_id IN (SELECT kb_id FROM docs WHERE doc_id < 5)", name="acl03_visible_requested")
def acl03_visible_requested(t):
    return A.visible_kbs(t.users, t.kbs, t.grants, t.docs.where("doc_id < 5"))


@query("""WITH a AS (SELECT DISTINCT user_id, concat('src', event_id % 23) AS kb_id, CASE WHEN event_id % 2 = 0 THEN 'kb:read' ELSE 'kb:write' END AS permission FROM events),
r AS (SELECT a.*, CASE WHEN k.kb_id IS NULL THEN 'not_found' WHEN u.role_name = 'admin' THEN 'admin' WHEN k.creator_id = a.user_id THEN 'creator' WHEN EXISTS (SELECT 1 FROM grants AS g WHERE g.user_id = a.user_id AND g.kb_id = a.kb_id AND g.permission_code = a.permission) THEN 'granted'
  WHEN NOT (a.permission = 'kb:read' AND a.user_id % 4 = 1) THEN 'denied' WHEN k.department = 'GUEST' THEN 'open' WHEN upper(trim(u.department)) <> k.department THEN 'department' ELSE 'global' END AS reason
  FROM a JOIN users AS u ON u.user_id = a.user_id LEFT JOIN kbs AS k ON k.kb_id = a.kb_id)
SELECT user_id, kb_id, permission, reason NOT IN ('not_found', 'denied', 'department') AS allowed, reason FROM r""")
def acl04_access_matrix(t):
    asked = t.events.selectExpr("user_id", "concat('src', event_id % 23) AS kb_id", "CASE WHEN event_id % 2 = 0 THEN 'kb:read' ELSE 'kb:write' END AS permission").distinct()
    codes = t.users.where("user_id % 4 = 1").select("user_id", F.lit("kb:read").alias("code"))
    return A.access_matrix(asked, t.users, t.kbs, t.grants, codes)


@query(f"WITH {_VIS} SELECT kb_id, name FROM kbs WHERE kb_id IN (SELECT kb_id FROM vis WHERE user_id = 3) AND contains(lower(name), 'base 1') ORDER BY creator_id DESC, kb_id LIMIT 4 OFFSET 1")
def acl05_list_kbs(t):
    return A.list_kbs(A.visible_kbs(t.users, t.kbs, t.grants), t.kbs, 3, "Base 1").select("kb_id", "name").orderBy(F.desc(F.expr("CAST(substring(kb_id, 4) AS INT)"))).offset(1).limit(4)


@query("""WITH r AS (SELECT DISTINCT role FROM user_roles), g AS (SELECT DISTINCT ur.role, g.kb_id FROM grants AS g JOIN user_roles AS ur ON ur.user_id = g.user_id WHERE g.user_id % 40 = 3)
SELECT r.role, k.kb_id FROM r JOIN kbs AS k ON k.status = 'active' AND (k.department = 'GUEST' OR r.role IN ('admin', 'super_admin') OR EXISTS (SELECT 1 FROM g WHERE g.role = r.role AND g.kb_id = k.kb_id))""")
def acl06_role_kbs(t):
    given = t.grants.where("user_id % 40 = 3").join(t.user_roles, "user_id").select("role", "kb_id")
    return A.role_kbs(t.user_roles.select("role").distinct(), t.kbs, given)


@query(f"WITH r AS (SELECT user_id, max({_RANK}) AS rank FROM user_roles GROUP BY user_id) SELECT a.user_id, (SELECT count(*) FROM r AS b WHERE b.rank < a.rank) AS n_below FROM r AS a")
def acl07_manageable(t):
    return A.manageable(A.user_ranks(t.users, t.user_roles))


@query("SELECT DISTINCT user_id, CASE WHEN role = 'super_admin' AND user_id <> 1 THEN 'admin' ELSE role END AS role FROM user_roles")
def acl08_repair_super_admins(t):
    return A.repair_super_admins(t.user_roles, 1)


@query("SELECT DISTINCT user_id, CASE role WHEN 'user' THEN 'guest' WHEN 'kb_admin' THEN 'staff' ELSE role END AS role FROM user_roles")
def acl09_migrate_roles(t):
    return A.migrate_roles(t.user_roles)


@query("SELECT kb_id, CASE WHEN creator_id % 3 = 0 THEN 'GUEST' ELSE department END AS department, CASE WHEN creator_id % 3 = 0 OR department = 'GUEST' THEN 'public' ELSE 'restricted' END AS visibility FROM kbs")
def acl10_repair_visibility(t):
    return A.repair_visibility(t.kbs.withColumn("visibility", F.when(F.col("creator_id") % 3 == 0, "public")))


@query("SELECT 'user' AS kind, user_id::VARCHAR AS id, CASE WHEN upper(trim(department)) = 'B' THEN 'C' ELSE department END AS department FROM users UNION ALL SELECT 'kb' AS kind, kb_id AS id, CASE WHEN department = 'B' THEN 'C' ELSE department END AS department FROM kbs")
def acl11_rename_department(t):
    both = t.users.select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id"), "department").unionByName(t.kbs.select(F.lit("kb").alias("kind"), F.col("kb_id").alias("id"), "department"))
    return A.rename_department(both, "B", "C")


@query("SELECT kb_id, CASE WHEN department = 'B' THEN NULL ELSE department END AS department, CASE WHEN department = 'GUEST' THEN 'public' ELSE 'restricted' END AS visibility FROM kbs")
def acl11_drop_department(t):
    return A.drop_department(t.kbs.withColumn("visibility", F.when(F.col("department").isin("GUEST", "B"), "public").otherwise("restricted")), "B").select("kb_id", "department", "visibility")


@query("SELECT user_id, CASE WHEN user_id % 10 = 4 THEN 'Z' ELSE department END AS department FROM users")
def acl12_assign_department(t):
    """A good batch, on top of one that is refused for an unknown id."""
    refused = A.assign_department(t.users, t.users.where("user_id % 10 = 3").selectExpr("user_id", "'Y' AS new_department").unionByName(t.users.limit(1).selectExpr("-1L AS user_id", "'Y' AS new_department")))
    return A.assign_department(refused, t.users.where("user_id % 10 = 4").selectExpr("user_id", "'Z' AS new_department"))
