"""Aggregates, trends, builds, order and pages."""

from pyspark.sql import functions as F

from runlens.operators import aggregates as a
from runlens.operators import builds as b
from runlens.operators import context, paging
from runlens.operators.agents import last_login
from runlens.operators.predicates import LAYER_PATTERNS
from runlens.plans import rollup, trends
from runlens.session import work_dir

from .registry import check

# ---------------------------------------------------------------- counts and groups


@check("A1_count_where", "SELECT count(*) AS amount FROM runs WHERE upper(status) = 'READY'")
def _(t):
    return a.count_where(t.runs, F.upper("status") == "READY")


@check("A1_count_all", "SELECT count(*) AS amount FROM runs")
def _(t):
    return a.count_all(t.runs)


MONTH_SQL = """
SELECT upper(status) AS label, CAST(month(last_activity) AS INT) AS month_no, count(status) AS amount,
  monthname(last_activity) AS month FROM runs_o {where} GROUP BY ALL
"""


@check("A2_status_month", MONTH_SQL.format(where=""))
def _(t):
    return a.runs_by_status_month(t.runs_o)


@check("A2_status_year_month", """
SELECT upper(status) AS label, CAST(year(last_activity) AS INT) AS year_no, CAST(month(last_activity) AS INT) AS month_no,
  count(status) AS amount, monthname(last_activity) AS month FROM runs_o GROUP BY ALL
""")
def _(t):
    return a.runs_by_status_month(t.runs_o, "year_month")


for _status in a.STATUSES:

    @check(f"A3_months_{_status}", MONTH_SQL.format(where=f"WHERE upper(status) = '{_status.upper()}'"))
    def _(t, status=_status):
        return a.runs_by_month_for_status(t.runs_o, status)


@check("A3_runs_warning", MONTH_SQL.format(where="WHERE upper(status) = 'WARNING'").replace("runs_o", "runs"))
def _(t):
    return a.runs_by_month_for_status(t.runs, "warning")


@check("A3_month_matrix", """
SELECT CAST(month(last_activity) AS INT) AS month_no, monthname(last_activity) AS month, """ + ", ".join(
    f"count(*) FILTER (upper(status) = '{s.upper()}') AS {s}" for s in a.STATUSES
) + """ FROM runs_o WHERE upper(status) IN ('READY', 'ERROR', 'WARNING', 'RUNNING') GROUP BY ALL
""")
def _(t):
    return a.month_status_matrix(t.runs_o)


@check("A4_runs_by_status", "SELECT min(status) AS status, count(status) AS amount FROM runs GROUP BY upper(status)")
def _(t):
    return a.runs_by_status(t.runs)


@check("A5_runs_by_job", """
SELECT min(job_name) AS job_name, min(dimension) AS dimension, count(job_name) AS amount FROM runs GROUP BY upper(job_name), upper(dimension)
""")
def _(t):
    return a.runs_by_job(t.runs)


@check("A6_runs_by_job_status", """
SELECT min(job_name) AS job_name, min(dimension) AS dimension, min(status) AS status, count(status) AS amount
FROM runs GROUP BY upper(job_name), upper(dimension), upper(status)
""")
def _(t):
    return a.runs_by_job_status(t.runs)


LAYER_TESTS = {
    "stg": "contains(upper(job_name), 'STG')",
    "dim": "contains(upper(job_name), 'DIM')",
    "fact": "regexp_matches(upper(job_name), 'MET|METRIC|FATO|FAT|FACT')",
    "dw": "contains(upper(dimension), 'DW')",
    "dm": "contains(upper(dimension), 'DM')",
}


@check("A7_layer_counts", "SELECT " + ", ".join(
    f"count(*) FILTER ({test}) AS {name}" for name, test in LAYER_TESTS.items()
) + " FROM runs")
def _(t):
    return a.layer_counts(t.runs)


for _layer, (_column, _) in LAYER_PATTERNS.items():

    @check(f"A8_executions_{_layer}", f"""
    SELECT min({_column}) AS {_layer}, count({_column}) AS amount FROM runs WHERE {LAYER_TESTS[_layer]} GROUP BY upper({_column})
    """)
    def _(t, layer=_layer):
        return a.executions_by_layer(t.runs, layer)


@check("A10_total", "SELECT CAST(sum(file_uploaded) AS BIGINT) AS file_uploaded FROM job_info")
def _(t):
    return a.total(t.job_info, "file_uploaded")


@check("A10_total_of_nothing", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_quantity < 0")
def _(t):
    return a.total(t.lineitem.where("l_quantity < 0"), "l_linenumber", "lines")


@check("A11_summary", """
SELECT max(l_quantity) AS max_qty, min(l_quantity) AS min_qty, round(avg(l_quantity), 6) AS avg_qty, sum(l_quantity) AS sum_qty FROM lineitem
""")
def _(t):
    return a.summary(t.lineitem, "l_quantity", alias="qty").withColumn("avg_qty", F.round("avg_qty", 6))


@check("A11_single", "SELECT max(o_totalprice) AS o_totalprice FROM orders")
def _(t):
    return a.summary(t.orders, "o_totalprice", ["max"])


@check("A12_group_count", "SELECT count(*) AS amount FROM (SELECT o_custkey, upper(o_orderstatus) FROM orders GROUP BY 1, 2)")
def _(t):
    return a.group_count(t.orders, "o_custkey", "o_orderstatus")


@check("A12_group_count_null", "SELECT count(*) AS amount FROM (SELECT upper(dimension) FROM runs GROUP BY 1)")
def _(t):
    return a.group_count(t.runs, "dimension")


@check("A12_group_count_text", "SELECT count(*) AS amount FROM (SELECT upper(job_name), upper(status) FROM runs GROUP BY 1, 2)")
def _(t):
    return a.group_count(t.runs, "job_name", "status")


@check("A13_date_span", "SELECT min(last_activity) AS first_date, max(last_activity) AS last_date FROM runs")
def _(t):
    return a.date_span(t.runs)


@check("A14_status_tally", "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in a.STATUSES)
       + ", count(*) FILTER (status IS NULL OR status NOT IN ('ready', 'error', 'warning', 'running')) AS other, count(*) AS total FROM runs")
def _(t):
    return a.status_tally(t.runs)


@check("A15_status_percent", " UNION ALL ".join(
    f"SELECT '{s}' AS status, count(*) FILTER (upper(status) = '{s.upper()}') AS amount, count(*) AS total, "
    f"CAST(floor(count(*) FILTER (upper(status) = '{s.upper()}') * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM runs"
    for s in a.STATUSES
))
def _(t):
    return a.status_percent(t.runs)


PANEL = ["status", "job_name", "dimension", "environment"]


@check("A16_distinct_values", " UNION ALL ".join(
    f"SELECT '{c}' AS field, min({c}) AS value, count(*) AS amount FROM runs GROUP BY upper({c})" for c in PANEL
))
def _(t):
    return a.distinct_values(t.runs, PANEL)


@check("A17_distinct_count", "SELECT count(*) AS amount FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(t):
    return a.distinct_count(t.orders, "o_custkey")


@check("A17_distinct_count_text", "SELECT count(DISTINCT upper(status)) AS amount FROM runs")
def _(t):
    return a.distinct_count(t.runs, "status")


@check("A18_active_count", "SELECT count(*) AS amount FROM ctx WHERE IsActive = 1")
def _(t):
    return context.active_contexts(t.ctx)


@check("A18_active_users", "SELECT count(*) AS amount FROM users WHERE isDeleted = 0")
def _(t):
    return a.active_count(t.users, "isDeleted", 0)


@check("A19_group_by", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2
""")
def _(t):
    return a.group_by(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "n": F.count(F.lit(1)), "qty": F.sum("l_quantity"), "last_ship": F.max("l_shipdate"),
    })


@check("A20_having", """
SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 12 OR max(o_totalprice) > 499000
""")
def _(t):
    aggs = {"n": F.count(F.lit(1)), "top": F.max("o_totalprice")}
    return a.having(t.orders, ["o_custkey"], aggs, (F.col("n") > 12) | (F.col("top") > 499000))


@check("A21_count_results", "SELECT count(*) AS amount FROM (SELECT o_custkey, count(*) FROM orders GROUP BY 1 HAVING count(*) > 5)")
def _(t):
    many = a.having(t.orders, ["o_custkey"], {"n": F.count(F.lit(1))}, F.col("n") > 5)
    return a.count_results(many.orderBy("o_custkey"))


@check("A22_distinct_rows", "SELECT DISTINCT job_name, reprocess FROM runs WHERE reprocess = 1")
def _(t):
    return a.reprocess_jobs(t.runs)


@check("A22_distinct_rows_text", "SELECT min(status) AS status, min(environment) AS environment FROM runs GROUP BY upper(status), upper(environment)")
def _(t):
    return a.distinct_rows(t.runs, ["status", "environment"])


@check("A23_context_panel", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(DISTINCT {c}) AS available, count(*) FILTER (IsActive = 1) AS active FROM {n}"
    for k, n, c in (("project", "proj", "ProjectName"), ("environment", "env", "Environment"), ("context", "ctx", "ContextKey"))
))
def _(t):
    return context.context_panel(t.ctx, t.env, t.proj)


# ---------------------------------------------------------------- windows, growth, dashboard

# The driver log covers one month; moving every third run back by half its id in minutes spreads it.
OLD_RUNS = "id, status, job_name, dimension, last_activity - CASE id % 3 WHEN 0 THEN {d45} WHEN 1 THEN {d100} ELSE {d0} END AS last_activity"
OLD_RUNS_CTE = "spread AS (SELECT " + OLD_RUNS.format(
    d45="INTERVAL 45 DAY", d100="INTERVAL 100 DAY", d0="INTERVAL 0 DAY"
) + " FROM runs)"


def spread(t):
    span = F.when(F.col("id") % 3 == 0, F.make_dt_interval(F.lit(45))).when(
        F.col("id") % 3 == 1, F.make_dt_interval(F.lit(100))
    ).otherwise(F.make_dt_interval(F.lit(0)))
    return t.runs.select("id", "status", "job_name", "dimension", (F.col("last_activity") - span).alias("last_activity"))


AS_OF = "2024-01-31 12:00:00"

WINDOW_SQL = " UNION ALL ".join(f"""
SELECT {d} AS days, upper(status) AS label, CAST(month(last_activity) AS INT) AS month_no, count(*) AS amount,
  max(last_activity) AS date, monthname(last_activity) AS month
FROM {{table}} WHERE upper(status) IN ('READY', 'ERROR', 'WARNING', 'RUNNING')
  AND last_activity BETWEEN {{end}} - INTERVAL {d} DAY AND {{end}} GROUP BY ALL""" for d in (30, 90, 180))

GROWTH_SQL = """
SELECT d.days, s.label, g.latest, g.earliest,
  CASE WHEN latest > earliest THEN 'up' WHEN latest IS NOT NULL THEN 'down' END AS direction,
  CAST(floor(CASE WHEN latest > earliest THEN (latest / CAST(earliest AS DOUBLE) - 1) * 100
    ELSE (1 - latest / CAST(earliest AS DOUBLE)) * 100 END + 0.5) AS BIGINT) AS percent
FROM (VALUES (30), (90), (180)) d(days) CROSS JOIN (VALUES ('READY'), ('ERROR'), ('WARNING'), ('RUNNING')) s(label)
LEFT JOIN (SELECT days, label, arg_max(amount, date) AS latest, arg_min(amount, date) AS earliest FROM counts GROUP BY 1, 2) g
  ON g.days = d.days AND g.label = s.label
"""

_END = f"TIMESTAMP '{AS_OF}'"


@check("A9_window_counts", "SELECT * FROM (" + WINDOW_SQL.format(table="spread", end=_END) + ")", ctes=OLD_RUNS_CTE)
def _(t):
    return trends.window_counts(spread(t), as_of=AS_OF)


@check("A9_window_counts_latest", "SELECT * FROM (" + WINDOW_SQL.format(
    table="spread", end="(SELECT max(last_activity) FROM spread)") + ")", ctes=OLD_RUNS_CTE)
def _(t):
    return trends.window_counts(spread(t))


@check("W1_growth", GROWTH_SQL, ctes=OLD_RUNS_CTE + ", counts AS (" + WINDOW_SQL.format(table="spread", end=_END) + ")")
def _(t):
    return trends.growth(spread(t), as_of=AS_OF)


@check("W1_growth_orders", GROWTH_SQL, ctes="counts AS (" + WINDOW_SQL.format(
    table="runs_o", end="TIMESTAMP '2001-07-15 00:00:00'") + ")")
def _(t):
    return trends.growth(t.runs_o, as_of="2001-07-15 00:00:00")


@check("R3_filter_panel", " UNION ALL ".join(
    f"SELECT '{c}' AS field, min(CAST({c} AS VARCHAR)) AS value, count(*) AS amount FROM runs GROUP BY upper(CAST({c} AS VARCHAR))"
    for c in [*PANEL, "reprocess"]
))
def _(t):
    return trends.filter_panel(t.runs)


def _dash(series, where="TRUE", days="NULL", label="NULL", month="NULL", job="NULL", dim="NULL"):
    texts = {n: f"CAST({e} AS VARCHAR)" for n, e in (("label", label), ("job_name", job), ("dimension", dim))}
    shown = {n: f"min({e}) AS {n}" for n, e in texts.items()}
    return f"""SELECT '{series}' AS series, CAST({days} AS INT) AS days, {shown['label']},
    CAST({month} AS INT) AS month_no, {shown['job_name']}, {shown['dimension']},
    count(*) AS amount, max(last_activity) AS date FROM spread WHERE {where}
    GROUP BY CAST({month} AS INT), {", ".join(f"upper({e})" for e in texts.values())} HAVING count(*) > 0"""


_KNOWN = "upper(status) IN ('READY', 'ERROR', 'WARNING', 'RUNNING')"
_MONTH = "month(last_activity)"
DASHBOARD_SQL = " UNION ALL ".join([
    _dash("month", _KNOWN, label="upper(status)", month=_MONTH),
    _dash("status", label="status"),
    _dash("job", job="job_name", dim="dimension"),
    _dash("job_status", label="status", job="job_name", dim="dimension"),
    _dash("all"),
    *[_dash("window", f"{_KNOWN} AND last_activity BETWEEN {_END} - INTERVAL {d} DAY AND {_END}", str(d), "upper(status)", _MONTH)
      for d in (30, 90, 180)],
    *[_dash("layer", test, label=f"'{name}'") for name, test in LAYER_TESTS.items()],
    *[_dash("layer_runs", LAYER_TESTS[n], label=f"'{n}'", job="job_name") for n in ("stg", "dim", "fact")],
    _dash("layer_runs", LAYER_TESTS["dw"], label="'dw'", dim="dimension"),
])


@check("D1_dashboard", DASHBOARD_SQL, ctes=OLD_RUNS_CTE)
def _(t):
    return trends.dashboard(spread(t), AS_OF)


# the roll-up begins without a third of the runs; then only the days that get runs or lose some are counted again
@check("D1_dashboard_rollup", DASHBOARD_SQL, ctes=OLD_RUNS_CTE)
def _(t):
    path, runs = work_dir(t.spark, "day-rollup"), spread(t)
    before = runs.where("id % 3 <> 0").withColumn("status", F.when(F.col("id") % 5 == 0, "running").otherwise(F.col("status")))
    rollup.build(before, path)
    rollup.refresh(runs, path, rollup.changed_days(before.where("id % 5 = 0"), runs.where("id % 3 = 0 or id % 5 = 0")))
    return rollup.dashboard(t.spark.read.parquet(path), runs, AS_OF)


@check("D1_growth_from_bundle", GROWTH_SQL, ctes=OLD_RUNS_CTE + ", counts AS (" + WINDOW_SQL.format(table="spread", end=_END) + ")")
def _(t):
    return trends.growth_of(trends.series(trends.dashboard(spread(t), AS_OF), "window"))


# ---------------------------------------------------------------- builds


@check("W2_latest_build", "SELECT * FROM builds b WHERE number = (SELECT max(number) FROM builds x WHERE x.job = b.job)")
def _(t):
    return b.latest_build(t.builds)


@check("W3_last_build_numbers", """
SELECT job, max(number) AS last, max(number) FILTER (result IN ('SUCCESS', 'UNSTABLE', 'FAILURE', 'ABORTED', 'NOT_BUILT')) AS last_completed,
  max(number) FILTER (result = 'SUCCESS') AS last_stable, max(number) FILTER (result = 'UNSTABLE') AS last_unstable,
  max(number) FILTER (result IN ('SUCCESS', 'UNSTABLE')) AS last_successful,
  max(number) FILTER (result IN ('UNSTABLE', 'FAILURE', 'ABORTED', 'NOT_BUILT')) AS last_unsuccessful,
  max(number) FILTER (result = 'FAILURE') AS last_failed FROM builds GROUP BY job
""")
def _(t):
    return b.last_build_numbers(t.builds)


for _kind, _result in {"last_failed": "FAILURE", "last_stable": "SUCCESS"}.items():

    @check(f"W3_{_kind}", f"""
    SELECT * FROM builds b WHERE number = (SELECT max(number) FROM builds x WHERE x.job = b.job AND x.result = '{_result}')
    """)
    def _(t, kind=_kind):
        return b.last_build_by_result(t.builds, kind)


RANGE_SQL = "SELECT *, row_number() OVER (PARTITION BY job ORDER BY number DESC) - 1 AS position FROM builds"


@check("W4_build_range", RANGE_SQL)
def _(t):
    return b.build_range(t.builds, block=1000)


@check("W4_build_range_part", f"SELECT * FROM ({RANGE_SQL}) WHERE position >= 50 AND position < 700")
def _(t):
    return b.build_range(t.builds, lo=50, hi=700, block=500)


@check("W4_build_range_job", f"SELECT * FROM ({RANGE_SQL}) WHERE position < 20 AND job = '5-LOW'")
def _(t):
    return b.build_range(t.builds, "5-LOW", 0, 20)


@check("W5_last_login", "SELECT userId, max(id) AS id, arg_max(createdDtm, id) AS createdDtm FROM logins GROUP BY userId")
def _(t):
    return last_login(t.logins)


for _which, _cond, _order in (
    ("first", "TRUE", ""), ("last", "TRUE", "DESC"),
    ("next", "o_orderkey > 500", ""), ("previous", "o_orderkey < 500", "DESC"),
):

    @check(f"W6_row_{_which}", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_cond} ORDER BY o_orderkey {_order} LIMIT 1")
    def _(t, which=_which):
        return paging.row_at(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", which, 500)


# ---------------------------------------------------------------- order and pages


@check("O1_sort", "SELECT * FROM orders")
def _(t):
    return paging.sort(t.orders, [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")])


@check("O2_shuffle_rows", "SELECT o_orderkey FROM orders")
def _(t):
    return paging.shuffle_rows(t.orders, 7).select("o_orderkey")


@check("O3_latest", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 6")
def _(t):
    return paging.latest_rows(t.events, by="event_id").select("event_id", "event_type")


@check("O3_latest_runs", "SELECT status, job_name, event_text, records_processed FROM runs ORDER BY id DESC LIMIT 6")
def _(t):
    return paging.latest_rows(t.runs).select("status", "job_name", "event_text", "records_processed")


@check("O4_page", "SELECT userId, name FROM users ORDER BY userId DESC LIMIT 10 OFFSET 20")
def _(t):
    return paging.page(t.users, [("userId", "desc")], offset=20).select("userId", "name")


@check("O4_page_after", "SELECT userId, name FROM users WHERE userId < 101 ORDER BY userId DESC LIMIT 10")
def _(t):
    return paging.page_after(t.users, "userId", 101).select("userId", "name")


@check("O5_page_with_total", """
SELECT userId, email, (SELECT count(*) FROM users WHERE isDeleted = 0) AS total FROM users WHERE isDeleted = 0 ORDER BY userId DESC LIMIT 10 OFFSET 10
""")
def _(t):
    rows = t.users.where("isDeleted = 0").select("userId", "email")
    return paging.page_with_total(rows, [("userId", "desc")], offset=10)


# a page in the depth of the log, found by counts of ranges
@check("O4_deep_page", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
LIMIT 50 OFFSET (SELECT CAST(count(*) * 3 / 4 AS BIGINT) FROM lineitem)
""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    offset = int(rows.count() * 3 / 4 + 0.5)
    return paging.page(rows, [("l_extendedprice", "desc"), ("l_orderkey", "asc"), ("l_linenumber", "asc")], 50, offset)


# the first column has three values only, so the ranges go on with the second
@check("O5_deep_total", """
SELECT l_returnflag, l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS total FROM lineitem
ORDER BY l_returnflag, l_orderkey, l_linenumber LIMIT 20 OFFSET 12000
""")
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber")
    return paging.page_with_total(rows, [("l_returnflag", "asc"), ("l_orderkey", "asc"), ("l_linenumber", "asc")], 20, 12_000)


@check("O6_grid", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(concat_ws('  ', CAST(p_partkey AS VARCHAR), p_name, p_brand)), 'ring')
  AND contains(lower(concat_ws('  ', CAST(p_partkey AS VARCHAR), p_name, p_brand)), '#1')
ORDER BY p_name DESC, p_partkey LIMIT 25
""")
def _(t):
    return paging.grid(t.part.select("p_partkey", "p_name", "p_brand"), "Ring #1", limit=25)
