"""Joins, existence tests, contexts, access and set operations."""

from pyspark.sql import functions as F

from runlens.operators import access, context, joins, tree
from runlens.operators.aggregates import month_labels
from runlens.session import work_dir

from .registry import check
from .tables_checks import CONTEXT_SQL


@check("J1_contexts", """
SELECT e.Environment, p.ProjectName, cd.* FROM ctx cd JOIN env e ON cd.EnvironmentFK = e.Id
JOIN proj p ON cd.ProjectDetailsFK = p.Id
""")
def _(t):
    return context.contexts(t.ctx, t.env, t.proj)


@check("J2_context_by_key", """
SELECT cd.Id, cd.ContextValue FROM ctx cd JOIN env e ON cd.EnvironmentFK = e.Id JOIN proj p ON cd.ProjectDetailsFK = p.Id
WHERE upper(cd.ContextKey) = 'BRAND#2-11' AND upper(p.ProjectName) = 'AMERICA'
""")
def _(t):
    return context.context_by_key(t.ctx, t.env, t.proj, "brand#2-11", "America").select("Id", "ContextValue")


@check("J2_context_by_id", "SELECT cd.Id, e.Environment FROM ctx cd JOIN env e ON cd.EnvironmentFK = e.Id WHERE cd.Id = 42")
def _(t):
    return context.context_by_key(t.ctx, t.env, t.proj, "", id=42).select("Id", "Environment")


@check("J3_context_view", CONTEXT_SQL)
def _(t):
    return context.context_view(t.ctx, t.proj, t.env)


@check("J4_users_with_role", """
SELECT u.userId, u.email, r.role, g.name AS "group" FROM users u LEFT JOIN roles r ON r.roleId = u.roleId
LEFT JOIN user_groups g ON g.id = u.groupId
""")
def _(t):
    return joins.users_with_role(t.users, t.roles, t.user_groups).select("userId", "email", "role", "group")


@check("J4_user_listing", """
SELECT u.userId, r.role, g.name AS "group" FROM users u LEFT JOIN roles r ON r.roleId = u.roleId
LEFT JOIN user_groups g ON g.id = u.groupId
WHERE u.isDeleted = 0 AND u.roleId <> 1 AND (upper(u.email) LIKE '%7%' OR upper(u.name) LIKE '%7%' OR upper(u.mobile) LIKE '%7%')
""")
def _(t):
    return joins.user_listing(t.users, t.roles, t.user_groups, "7").select("userId", "role", "group")


@check("J4_user_page", """
SELECT u.userId, u.email, u.name, u.mobile, r.role, g.name AS "group" FROM users u LEFT JOIN roles r ON r.roleId = u.roleId
LEFT JOIN user_groups g ON g.id = u.groupId
WHERE u.isDeleted = 0 AND u.roleId <> 1 AND (upper(u.email) LIKE '%7%' OR upper(u.name) LIKE '%7%' OR upper(u.mobile) LIKE '%7%')
ORDER BY u.userId DESC LIMIT 10 OFFSET 5
""")
def _(t):
    return joins.user_page(t.users, t.roles, t.user_groups, "7", 10, 5)


@check("J5_user_profile", """
SELECT u.userId, u.name, r.role, g.name AS "group" FROM users u JOIN roles r ON r.roleId = u.roleId
LEFT JOIN user_groups g ON g.id = u.groupId WHERE u.isDeleted = 0
""")
def _(t):
    return joins.user_profile(t.users, t.roles, t.user_groups).select("userId", "name", "role", "group")


@check("J6_errors_for_instance", """
SELECT e.id, e.tmf_id, e.job_name, e.moment, e.type, e.origin, e.message, e.code, count(*) AS copies
FROM errs e JOIN runs r ON e.tmf_id = r.instance_id GROUP BY ALL
""")
def _(t):
    return joins.errors_for_instance(t.errs, t.runs)


@check("J6_errors_one_instance", """
SELECT e.id, e.tmf_id, e.code, count(*) AS copies FROM errs e JOIN runs r ON e.tmf_id = r.instance_id
WHERE e.tmf_id = 'I0' GROUP BY ALL
""")
def _(t):
    return joins.errors_for_instance(t.errs, t.runs, "I0").select("id", "tmf_id", "code", "copies")


@check("J6_distinct_errors", "SELECT DISTINCT e.* FROM errs e JOIN runs r ON e.tmf_id = r.instance_id")
def _(t):
    return joins.errors_for_instance(t.errs, t.runs, distinct_errors=True)


@check("J7_templates_with_smtp", """
SELECT e.*, s.smtp_host, s.smtp_port, s.username, s.password, s.ssl FROM email e JOIN smtp s ON s.name = e.smtp
""")
def _(t):
    return joins.templates_with_smtp(t.email, t.smtp)


@check("J8_children_with_flag", """
SELECT f.*, CASE WHEN f.id IN (SELECT parent_id FROM tree WHERE mime = 'directory') THEN 1 ELSE 0 END AS dirs FROM tree f
""")
def _(t):
    return tree.children_with_flag(t.tree)


@check("J9_reports_for_user", """
SELECT r.* FROM reports r WHERE upper(r.groups) IN (
  SELECT upper(g.name) FROM users u JOIN user_groups g ON u.groupId = g.id WHERE upper(u.name) = 'CUSTOMER#000000035')
""")
def _(t):
    user = "Customer#000000035"
    return access.reports_for_user(t.reports, t.users, t.user_groups, user)


@check("J9_all_group_reports", """
SELECT r.id, r.name FROM reports r WHERE upper(r.groups) IN (
  SELECT upper(g.name) FROM users u JOIN user_groups g ON u.groupId = g.id)
""")
def _(t):
    return access.all_group_reports(t.reports, t.users, t.user_groups).select("id", "name")


for _how, _sql in {"right": "RIGHT", "full": "FULL", "left": "LEFT", "inner": "INNER"}.items():

    @check(f"J10_join_{_how}", f"""
    SELECT s.s_suppkey, s.s_name, n.n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 2000) s
    {_sql} JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON s.s_nationkey = n.n_nationkey
    """)
    def _(t, how=_how):
        word = {"right": "RIGHT OUTER", "full": "OUTER", "left": "LEFT OUTER", "inner": "INNER"}[how]
        s, n = t.supplier.where("s_acctbal > 2000"), t.nation.where("n_regionkey <> 1")
        return joins.join_typed(s, n, s["s_nationkey"] == n["n_nationkey"], word).select("s_suppkey", "s_name", "n_name")


@check("J10_customers_orders", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey
""")
def _(t):
    return joins.join_typed(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@check("J11_join_using", "SELECT l_orderkey AS orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "orderkey")
    orders = t.orders.withColumnRenamed("o_orderkey", "orderkey")
    return joins.join_using(lines, orders, "orderkey").select("orderkey", "l_linenumber", "l_partkey", "o_orderstatus")


@check("J12_join_on", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders
ON l_orderkey = o_orderkey AND (l_quantity > 30 OR o_orderstatus = 'F')
""")
def _(t):
    return joins.join_on(
        t.lineitem, t.orders, [F.col("l_orderkey") == F.col("o_orderkey")],
        (F.col("l_quantity") > 30) | (F.col("o_orderstatus") == "F"),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus")


@check("J13_from_tables", "SELECT c_custkey, c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
def _(t):
    return joins.from_tables(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@check("J14_descendants", "SELECT id, parent_id, name, depth, path FROM walk", recursive=True, ctes="""
walk AS (SELECT id, parent_id, name, 0 AS depth, name AS path FROM tree WHERE id = 1 UNION ALL
  SELECT t.id, t.parent_id, t.name, w.depth + 1, w.path || '/' || t.name FROM tree t JOIN walk w ON t.parent_id = w.id)
""")
def _(t):
    return tree.descendants(t.tree, 1)


def stored_labels(t):
    path = work_dir(t.spark, "tree-labels")
    tree.store_labels(tree.label_tree(t.tree), path)
    return t.spark.read.parquet(path)


# the subtree as one range of stored interval labels
@check("J14_descendants_labels", "SELECT id, parent_id, name, depth, path FROM walk", recursive=True, ctes="""
walk AS (SELECT id, parent_id, name, 0 AS depth, name AS path FROM tree WHERE id = 3 UNION ALL
  SELECT t.id, t.parent_id, t.name, w.depth + 1, w.path || '/' || t.name FROM tree t JOIN walk w ON t.parent_id = w.id)
""")
def _(t):
    return tree.labelled_descendants(stored_labels(t), 3)


@check("V6_search_labels", """
SELECT t.id, t.name, d.path || '/' || t.name AS path FROM tree t JOIN dirs d ON t.parent_id = d.id
WHERE contains(upper(t.name), 'RING') AND t.id <> 1
""", recursive=True, ctes="""
dirs AS (SELECT id, name AS path FROM tree WHERE id = 1 UNION ALL
  SELECT t.id, w.path || '/' || t.name FROM tree t JOIN dirs w ON t.parent_id = w.id WHERE t.mime = 'directory')
""")
def _(t):
    return tree.search_tree(t.tree, 1, "ring", labels=stored_labels(t)).select("id", "name", "path")


@check("J14_ancestors", "SELECT id, ancestor_id, depth FROM walk", recursive=True, ctes="""
walk AS (SELECT t.id, t.parent_id AS ancestor_id, 1 AS depth FROM tree t WHERE t.parent_id IN (SELECT id FROM tree) UNION ALL
  SELECT w.id, t.parent_id, w.depth + 1 FROM walk w JOIN tree t ON t.id = w.ancestor_id WHERE t.parent_id IN (SELECT id FROM tree))
""")
def _(t):
    return tree.ancestors(t.tree, t.tree.select("id"))


@check("J15_new_rows", """
SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)
""")
def _(t):
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.new_rows(t.orders, known, ["o_custkey"]).select(*t.orders.columns)


@check("J15_first_of_new", """
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
""")
def _(t):
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.new_rows(t.orders, known, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@check("J16_duplicate_keys", """
SELECT lower(p_name) AS p_name, count(*) AS amount, min(p_partkey) AS first_p_partkey FROM part GROUP BY 1 HAVING count(*) > 1
""")
def _(t):
    return joins.duplicate_keys(t.part, "p_name", "p_partkey")


@check("J17_match_files", """
SELECT f.id, i.component_type, CASE WHEN i.file = 1 THEN i.file_name || i.component_type END AS required, f.delivered,
  coalesce(i.file = 2 OR f.delivered = CASE WHEN i.file = 1 THEN i.file_name || i.component_type END, FALSE) AS accepted
FROM (SELECT p_partkey AS id, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '.csv' ELSE '.json' END AS delivered FROM part) f
LEFT JOIN (SELECT * FROM job_info WHERE id % 11 <> 0) i ON i.id = f.id
""")
def _(t):
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".csv").otherwise(".json")
    files = t.part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix).alias("delivered"),
    )
    entries = t.job_info.where("id % 11 <> 0")
    matched = joins.match_files(files, entries, ["id"])
    return matched.join(entries.select("id", "component_type"), "id", "left").select(
        "id", "component_type", "required", "delivered", "accepted"
    )


# ---------------------------------------------------------------- set operations


@check("U1_visible_reports", """
SELECT name, type FROM reports WHERE upper(groups) IN (
  SELECT upper(g.name) FROM users u JOIN user_groups g ON u.groupId = g.id WHERE upper(u.name) = 'CUSTOMER#000000035')
UNION SELECT name, type FROM reports WHERE users LIKE '%*%'
""")
def _(t):
    return access.visible_reports(t.reports, t.users, t.user_groups, "Customer#000000035")


@check("U1_visible_strict", """
SELECT r.name, r.type FROM (SELECT *, unnest(string_split(groups, ',')) AS g FROM reports) r WHERE upper(trim(r.g)) IN (
  SELECT upper(g.name) FROM users u JOIN user_groups g ON u.groupId = g.id WHERE upper(u.name) = 'CUSTOMER#000000001')
UNION SELECT name, type FROM reports WHERE list_contains(string_split(upper(users), ','), 'CUSTOMER#000000001')
UNION SELECT name, type FROM reports WHERE users LIKE '%*%'
""")
def _(t):
    return access.visible_reports(t.reports, t.users, t.user_groups, "customer#000000001", "strict")


@check("U1_permission", """
SELECT count(*) > 0 AS allowed FROM (
  SELECT name FROM reports WHERE upper(name) = 'SUPPLIER#000000001' AND upper(groups) IN (
    SELECT upper(g.name) FROM users u JOIN user_groups g ON u.groupId = g.id WHERE upper(u.name) = 'CUSTOMER#000000002')
  UNION SELECT name FROM reports WHERE users LIKE '%*%')
""")
def _(t):
    return access.has_permission(t.reports, t.users, t.user_groups, "Customer#000000002", "Supplier#000000001")


@check("U2_month_labels", " UNION ".join(
    f"SELECT monthname(last_activity) AS month FROM runs_o WHERE upper(status) = '{s}' GROUP BY status, monthname(last_activity)"
    for s in ("READY", "ERROR", "WARNING", "RUNNING")
))
def _(t):
    return month_labels(t.runs_o)


@check("U3_merge_ids", "SELECT id FROM tree WHERE mime = 'directory' UNION SELECT parent_id AS id FROM tree")
def _(t):
    return tree.merge_ids(t.tree.where("mime = 'directory'").select("id"), t.tree.select(F.col("parent_id").alias("id")))


# ---------------------------------------------------------------- access and contexts


MEMBERS = """
members AS (SELECT upper(g.name) AS audience, count(DISTINCT u.name) AS n_users
  FROM users u JOIN user_groups g ON u.groupId = g.id GROUP BY 1)
"""


@check("R1_report_access", """
SELECT r.id AS report_id, r.name AS report, 'group' AS kind, m.audience, m.n_users
FROM reports r JOIN members m ON upper(trim(r.groups)) = m.audience
UNION ALL SELECT id, name, 'public', '*', (SELECT count(DISTINCT name) FROM users) FROM reports WHERE users LIKE '%*%'
""", ctes=MEMBERS)
def _(t):
    return access.report_access(t.reports, t.users, t.user_groups)


@check("R1_report_access_strict", """
SELECT r.id AS report_id, r.name AS report, 'group' AS kind, m.audience, m.n_users
FROM (SELECT *, unnest(string_split(groups, ',')) AS g FROM reports) r JOIN members m ON upper(trim(r.g)) = m.audience
UNION ALL SELECT id, name, 'public', '*', (SELECT count(DISTINCT name) FROM users) FROM reports WHERE users LIKE '%*%'
UNION ALL SELECT r.id, r.name, 'user', upper(r.u), 1 FROM (SELECT *, unnest(string_split(users, ',')) AS u FROM reports) r
WHERE r.u <> '*' AND upper(r.u) IN (SELECT upper(name) FROM users)
""", ctes=MEMBERS)
def _(t):
    return access.report_access(t.reports, t.users, t.user_groups, "strict")


@check("R2_resolve_context", """
SELECT upper(cd.ContextKey) AS context_key, e.Environment, count(*) AS n_matches,
  CASE WHEN count(*) = 1 THEN min(cd.ContextValue) END AS context_value
FROM ctx cd JOIN proj p ON cd.ProjectDetailsFK = p.Id JOIN env e ON cd.EnvironmentFK = e.Id GROUP BY 1, 2
""")
def _(t):
    return context.resolve_context(t.ctx, t.env, t.proj)


@check("R2_resolve_active", """
SELECT upper(cd.ContextKey) AS context_key, e.Environment, count(*) AS n_matches,
  CASE WHEN count(*) = 1 THEN min(cd.ContextValue) END AS context_value
FROM ctx cd JOIN proj p ON cd.ProjectDetailsFK = p.Id JOIN env e ON cd.EnvironmentFK = e.Id
WHERE upper(e.Environment) = 'DEV' AND upper(p.ProjectName) = 'ASIA' AND cd.IsActive = 1 GROUP BY 1, 2
""")
def _(t):
    return context.resolve_context(t.ctx, t.env, t.proj, "dev", "asia", True)


ENVIRONMENTS = ["LOCAL", "DEV", "QA", "UAT", "PREPROD", "PROD"]


@check("R2_context_matrix", "SELECT upper(c.ContextKey) AS context_key, " + ", ".join(
    f"CASE WHEN count(*) FILTER (c.Environment = '{e}') = 1 THEN min(c.ContextValue) FILTER (c.Environment = '{e}') END AS \"{e}\""
    for e in ENVIRONMENTS
) + " FROM named c GROUP BY 1", ctes=f"named AS ({CONTEXT_SQL})")
def _(t):
    return context.context_matrix(t.ctx, t.env, t.proj, ENVIRONMENTS)
