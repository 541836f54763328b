"""Scans, sources, sinks, projections and filters."""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions import labels
from runlens.operators import postings
from runlens.operators import predicates as p
from runlens.operators import projections as pr
from runlens.operators.context import context_view
from runlens.functions import text as tx
from runlens.session import work_dir, workers_find_package
from runlens.sources import builds as build_source
from runlens.sources import exports, registry, tables, workbooks
from runlens.streaming import lifecycle as live

from .adapters import DRIVER_TABLES
from .registry import check

# ---------------------------------------------------------------- scans, sources, sinks


@check("S1_scan", "SELECT * FROM events")
def _(t):
    return tables.scan(t.spark, t.directory, "events")


CONTEXT_SQL = """
SELECT cd.Id, cd.ContextKey, cd.ContextValue, cd.isEncrypted, pd.ProjectName, e.Environment,
       cd.Description, cd.IsActive
FROM ctx cd, proj pd, env e WHERE cd.ProjectDetailsFK = pd.Id AND cd.EnvironmentFK = e.Id
"""


@check("S2_context_view", CONTEXT_SQL)
def _(t):
    context_view(t.ctx, t.proj, t.env, "runlens_contexts")
    return t.spark.table("runlens_contexts")


def feed(t):
    """Job documents of at most 64 builds each, as JSON text."""
    page = F.floor(F.col("number") / 64)
    docs = t.builds.groupBy("job", page.alias("page")).agg(
        F.collect_list(F.struct("number", "timestamp", "duration", "result")).alias("builds")
    )
    return docs.select(F.to_json(F.struct(F.col("job").alias("name"), "builds")).alias("json"))


@check("S4_build_feed", "SELECT job, number, timestamp, duration, result FROM builds")
def _(t):
    return build_source.builds_from_text(feed(t))


@check("S4_build_feed_files", "SELECT job, number, timestamp, duration, result FROM builds")
def _(t):
    path = work_dir(t.spark, "feed")
    feed(t).write.text(path)
    return build_source.read_builds(t.spark, path)


# fields that no schema names stay readable
@check("S4_open_build_feed", """
SELECT number, job || ' #' || CAST(number AS VARCHAR) AS "fullDisplayName", result, timestamp, duration, 'http://ci/' || CAST(number AS VARCHAR) AS url,
  number * 2 AS "queueId", FALSE AS building, 'user' || CAST(number % 9 AS VARCHAR) AS "startedBy", CAST(number % 3 AS INT) AS commits FROM builds
""")
def _(t):
    number = F.col("number")
    name = F.concat("job", F.lit(" #"), number.cast("string")).alias("fullDisplayName")
    cause = F.struct(F.concat(F.lit("user"), (number % 9).cast("string")).alias("userName"))
    record = F.struct(
        "number", name, "result", "timestamp", "duration", F.concat(F.lit("http://ci/"), number.cast("string")).alias("url"),
        (number * 2).alias("queueId"), F.lit(False).alias("building"), F.array(F.struct(F.array(cause).alias("causes"))).alias("actions"),
        F.struct((number % 3).alias("size")).alias("changeSet"),
    )
    docs = t.builds.groupBy("job", F.floor(number / 64).alias("page")).agg(F.collect_list(record).alias("builds"))
    texts = docs.select(F.to_json(F.struct("builds")).alias("json"))
    extra = {"startedBy": ("$.actions[0].causes[0].userName", "string"), "commits": ("$.changeSet.size", "int")}
    return build_source.open_builds_from_text(texts, extra=extra).drop("record")


@check("S5_input_format", """
SELECT id, component_type AS found, '/data/in/' || file_name
  || CASE WHEN file = 1 THEN component_type ELSE '' END AS path FROM job_info
""")
def _(t):
    c = F.col("job_component")
    return t.job_info.select(
        "id", registry.input_format(c).alias("found"),
        registry.input_path("/data", F.col("file_path"), F.col("file_name"), c, F.col("file")).alias("path"),
    )


# suppliers in workbooks of a sheet per region, made by Spark and read back by the data source
@check("S5_workbooks", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS s_name, s_acctbal, CAST(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s_suppkey * 3601) AS TIMESTAMP) AS seen
FROM supplier
""")
def _(t):
    path = work_dir(t.spark, "workbooks")
    workers_find_package(t.spark)
    rows = t.supplier.select(
        "s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("s_name"), "s_acctbal",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s_suppkey") * 3601)).alias("seen"),
        (F.col("s_suppkey") % 3).alias("book"), (F.col("s_nationkey") % 5).alias("sheet"),
    )

    def write(group):
        sheets = {}
        for r in group.to_pylist():
            sheets.setdefault(f"region {r['sheet']}", [["key", "name", "balance", "seen"]]).append([r["s_suppkey"], r["s_name"], float(r["s_acctbal"]), r["seen"]])
        return pa.table({"content": [workbooks.workbook_bytes(sheets)]})

    books = rows.groupBy("book").applyInArrow(write, "content binary")
    books.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return registry.read_input(t.spark, {"component_type": ".xlsx", "path": path}, "s_suppkey bigint, s_name string, s_acctbal double, seen timestamp_ntz")


@check("S6_output_format", "SELECT id, component_type AS found, '/data/in/' || file_name || component_type AS path FROM job_info")
def _(t):
    c = F.replace(F.col("job_component"), F.lit("Input"), F.lit("Output"))
    return t.job_info.select(
        "id", registry.output_format(c).alias("found"),
        registry.output_path("/data", F.col("file_path"), F.col("file_name"), c).alias("path"),
    )


@check("S6_write_output", "SELECT id, status, job_name, dimension FROM runs")
def _(t):
    entry = {"component_type": ".json", "path": work_dir(t.spark, "out")}
    registry.write_output(t.runs.select("id", "status", "job_name", "dimension"), entry)
    return registry.read_input(t.spark, entry, "id long, status string, job_name string, dimension string")


@check("S7_json_result", "SELECT CAST(to_json({'id': id, 'status': status, 'dimension': dimension}) AS VARCHAR) AS data FROM runs")
def _(t):
    return exports.to_json_result(t.runs.select("id", "status", "dimension"))


@check("S8_csv_export", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def _(t):
    path = work_dir(t.spark, "csv")
    exports.export_csv(t.documents.select("doc_id", "text", "lang"), path, ";")
    options = {"header": "true", "sep": ";", "quote": '"', "escape": '"', "multiLine": "true"}
    return t.spark.read.options(**options).schema("doc_id string, text string, lang string").csv(path)


@check("S9_xml_export", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _(t):
    path = work_dir(t.spark, "xml")
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    exports.export_xml(rows, path)
    return t.spark.read.format("xml").option("rowTag", "element").schema(rows.schema).load(path)


@check("S10_append", "SELECT * FROM orders")
def _(t):
    path = work_dir(t.spark, "append")
    late = F.col("o_orderdate") >= "1998-01-01"
    tables.append(t.orders.where(~late), path)
    tables.append(t.orders.where(late), path)
    return t.spark.read.parquet(path)


@check("S11_landing_counts", """
SELECT regexp_extract(url, '[^/]*$') AS file_name, count(*) AS file_uploaded FROM pages GROUP BY 1
""")
def _(t):
    return registry.landing_counts(t.pages.select(F.col("url").alias("path")))


# real files, counted once each as they land; the registry is raised by what has come
@check("S11_file_stream", """
SELECT i.id, i.job_name, i.file_uploaded + coalesce(n, 0) AS file_uploaded FROM job_info i
LEFT JOIN (SELECT 'JOB_' || CAST(p_size AS VARCHAR) AS job_name, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n FROM part WHERE p_size > 5 GROUP BY 1) f USING (job_name)
""")
def _(t):
    folder, counts = work_dir(t.spark, "landing"), work_dir(t.spark, "landed")
    files = t.part.where("p_size > 5").withColumn("job", F.concat(F.lit("JOB_"), F.col("p_size").cast("string")))
    name = F.regexp_extract("path", "job=([^/]*)/", 1)
    # the rows of a file come from one task, so that only a job's last one is short, and a job's files from several
    file = F.floor((F.row_number().over(Window.partitionBy("job").orderBy("p_partkey")) - 1) / 20)
    dealt = files.withColumn("_file", file).repartition(4 * t.spark.sparkContext.defaultParallelism, "job", "_file").drop("_file")
    dealt.write.option("maxRecordsPerFile", 20).partitionBy("job").csv(folder)
    state = work_dir(t.spark, "landing-state")
    for _ in range(2):  # the second run finds nothing new
        stream = registry.file_stream(t.spark, folder, "*.csv", 40)
        live.start_available(stream, registry.landing_writer(counts, name, few=True), state).awaitTermination()
    return registry.registry_with_landed(t.job_info, registry.landed(t.spark, counts)).select("id", "job_name", "file_uploaded")


@check("S12_columns", """
SELECT table_name, CAST(ordinal_position - 1 AS INT) AS position, column_name AS name FROM information_schema.columns
WHERE table_name IN ('orders', 'events', 'part', 'nation')
""")
def _(t):
    return tables.describe_all(**{n: getattr(t, n) for n in ("orders", "events", "part", "nation")}).select("table_name", "position", "name")


@check("S12_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS amount FROM {n}"
    for n in DRIVER_TABLES
))
def _(t):
    return tables.row_counts(**{
        n: getattr(t, n) for n in DRIVER_TABLES
    })


@check("S13_sql_parameters", """
SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'error') AND value >= 10.5 GROUP BY user_id
""")
def _(t):
    return tables.query(
        t.spark,
        "SELECT user_id, count(*) AS n FROM param_events WHERE event_type IN ? AND value >= ? GROUP BY user_id",
        [["click", "error"], 10.5], param_events=t.events,
    )


# ---------------------------------------------------------------- projections


@check("P1_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return pr.project(t.orders, ["o_orderkey", "o_orderstatus"])


@check("P2_qualified_star", "SELECT e.Environment, cd.* FROM ctx cd JOIN env e ON cd.EnvironmentFK = e.Id")
def _(t):
    joined = t.ctx.alias("cd").join(t.env.alias("env"), F.col("cd.EnvironmentFK") == F.col("env.Id"))
    return pr.with_qualified_star(joined, "cd", ["env.Environment"])


@check("P3_rename", "SELECT userId AS id, email AS mail, name FROM users")
def _(t):
    return pr.rename(t.users.select("userId", "email", "name"), {"userId": "id", "email": "mail"})


@check("P4_chosen_column", "SELECT c_mktsegment FROM customer")
def _(t):
    return pr.project(t.customer, "c_mktsegment")


@check("P4_all_columns", "SELECT * FROM customer")
def _(t):
    return pr.project(t.customer, "all")


@check("P5_constants", "SELECT id, 0 AS dirs, CASE WHEN parent_id > 0 THEN 1 ELSE 0 END AS has_parent FROM tree")
def _(t):
    flag = F.when(F.col("parent_id") > 0, 1).otherwise(0)
    return pr.with_constants(t.tree.select("id", "parent_id"), dirs=0, has_parent=flag).drop("parent_id")


@check("P6_status_label", """
SELECT id,
  CASE status WHEN 'ready' THEN 'Ready' WHEN 'running' THEN 'Running' WHEN 'error' THEN 'Error'
    WHEN 'warning' THEN 'Warning' ELSE status END AS label,
  CASE status WHEN 'ready' THEN 'success' WHEN 'running' THEN 'info' WHEN 'error' THEN 'danger'
    WHEN 'warning' THEN 'warning' ELSE NULL END AS css,
  CASE status WHEN 'ready' THEN 'rgba(0, 166, 90, 1)' WHEN 'error' THEN 'rgba(221, 75, 57, 1)'
    WHEN 'running' THEN 'rgba(0, 192, 239, 1)' WHEN 'warning' THEN 'rgba(243, 156, 18, 1)'
    ELSE 'white' END AS colour
FROM runs
""")
def _(t):
    s = F.col("status")
    return t.runs.select(
        "id", labels.status_label(s).alias("label"), labels.status_class(s).alias("css"),
        labels.status_colour(s).alias("colour"),
    )


@check("P7_flag_text", "SELECT id, CASE WHEN reprocess = 1 THEN 'True' ELSE 'False' END AS flag FROM runs")
def _(t):
    return t.runs.select("id", labels.flag_text(F.col("reprocess")).alias("flag"))


@check("P8_null_to_empty", "SELECT id, coalesce(dimension, '') AS dimension, coalesce(msg, '') AS msg FROM runs")
def _(t):
    return t.runs.select("id", *[labels.null_to_empty(F.col(c)).alias(c) for c in ("dimension", "msg")])


@check("P9_rows_affected", """
SELECT id, CASE WHEN TRY_CAST(records_processed AS BIGINT) <> 0
  THEN records_processed || ' Rows Were Affected.' ELSE '' END AS note FROM runs
""")
def _(t):
    return t.runs.select("id", labels.rows_affected_text(F.col("records_processed")).alias("note"))


# ---------------------------------------------------------------- filters


@check("F1_filter_runs", """
SELECT * FROM runs WHERE upper(status) IN ('READY', 'ERROR') AND upper(job_name) IN ('STG_ORDERS', 'MET_MARGIN')
  AND upper(dimension) IN ('DW_MASTER', 'DW_SALES') AND upper(environment) IN ('DEV', 'PROD', 'QA')
  AND start_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
""")
def _(t):
    return p.filter_runs(
        t.runs, ["ready", "error"], ["stg_orders", "MET_MARGIN"], ["dw_master", "DW_Sales"],
        ["dev", "prod", "qa"], from_date="05-01-2024", to_date="20-01-2024",
    )


@check("F1_filter_text", """
SELECT * FROM runs WHERE contains(upper(event_text), '100%_D') AND reprocess = 0
  AND start_time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND (SELECT max(start_time) FROM runs)
""")
def _(t):
    return p.filter_runs(t.runs, ["*", "error"], event_text="100%_d", reprocess=0, from_date="10-01-2024")


@check("F1_filter_until", """
SELECT * FROM runs WHERE upper(status) = 'WARNING'
  AND start_time BETWEEN TIMESTAMP '2010-01-01 00:00:00' AND TIMESTAMP '2024-01-07 23:59:59'
""")
def _(t):
    return p.filter_runs(t.runs, ["WARNING"], [], None, ["*"], to_date="07-01-2024")


@check("F1_filter_by_keys", "SELECT id, status FROM runs WHERE upper(status) = 'READY' AND upper(environment) = 'DEV'")
def _(t):
    return p.filter_runs(p.with_keys(t.runs), ["ready"], environment=["dev"]).select("id", "status")


@check("F1_filter_stored", """
SELECT id, status, start_time FROM runs WHERE upper(status) IN ('READY', 'ERROR') AND upper(environment) = 'PROD'
  AND start_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
""")
def _(t):
    path = work_dir(t.spark, "runs")
    tables.store_runs(t.runs, path)
    found = p.filter_runs(
        t.spark.read.parquet(path), ["ready", "error"], environment=["prod"],
        from_date="05-01-2024", to_date="20-01-2024",
    )
    return found.select("id", "status", "start_time")


@check("F2_by_status", "SELECT * FROM runs WHERE upper(status) = 'READY'")
def _(t):
    return p.by_status(t.runs, "ready")


@check("F2_by_job", "SELECT * FROM runs WHERE upper(job_name) = 'STG_EVENTS'")
def _(t):
    return p.by_job(t.runs, "STG_Events")


@check("F2_by_id", "SELECT * FROM runs WHERE id = 77")
def _(t):
    return p.by_id(t.runs, 77)


@check("F3_by_keys", "SELECT * FROM part WHERE upper(p_brand) = 'BRAND#2' AND upper(p_type) = 'ECONOMY' AND p_size = 11")
def _(t):
    return p.by_keys(t.part, p_brand="brand#2", p_type="Economy", p_size=11)


@check("F4_not_equal", "SELECT * FROM users WHERE groupId <> 3")
def _(t):
    return p.not_equal(t.users, "groupId", 3)


@check("F5_between", "SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12.5")
def _(t):
    return p.between(t.lineitem, "l_quantity", 10, 12.5)


@check("F6_where_in", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t):
    return p.where_in(t.orders, "o_orderstatus", ["f", "P"])


@check("F6_where_in_table", """
SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
""")
def _(t):
    wanted = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    return p.where_in(t.orders, "o_custkey", wanted).select(*t.orders.columns)


@check("F7_where_not_in", "SELECT * FROM orders WHERE upper(o_orderpriority) NOT IN ('1-URGENT', '5-LOW')")
def _(t):
    return p.where_not_in(t.orders, "o_orderpriority", ["1-URGENT", "5-low"])


@check("F8_or_where_in", "SELECT * FROM orders WHERE o_orderstatus IN ('F') OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(t):
    return p.or_where_in(t.orders, [("o_orderstatus", ["F"], False), ("o_orderpriority", ["1-URGENT", "2-HIGH"], True)])


@check("F9_or_where", "SELECT * FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P' OR o_custkey < 5")
def _(t):
    return p.or_where(
        t.orders, F.col("o_totalprice") > 400000, F.col("o_orderstatus") == "P", F.col("o_custkey") < 5
    )


@check("F10_is_null", "SELECT id, job_name FROM runs WHERE dimension IS NULL AND msg IS NOT NULL")
def _(t):
    rows = p.where_value(t.runs, "dimension", None)
    return p.where_value(rows, "msg", None, "!=").select("id", "job_name")


@check("F10_operators", "SELECT * FROM part WHERE p_size >= 10 AND p_size < 40 AND upper(p_type) <> 'ECONOMY' AND p_retailprice > 950")
def _(t):
    rows = p.where_value(p.where_value(t.part, "p_size", 10, ">="), "p_size", 40, "<")
    return p.where_value(p.where_value(rows, "p_type", "economy", "!="), "p_retailprice", 950, ">")


@check("F11_like", "SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'RED') OR contains(upper(p_brand), '#1')")
def _(t):
    hit = tx.like_contains(F.col("p_name"), "red") | tx.like_contains(F.col("p_brand"), "#1")
    return t.part.where(hit).select("p_partkey", "p_name")


@check("F11_like_wildcards", "SELECT p_partkey FROM part WHERE upper(p_name) LIKE '%R%_D %'")
def _(t):
    return t.part.where(tx.like_contains(F.col("p_name"), "r%_d ", escape=False)).select("p_partkey")


@check("F12_like_sides", """
SELECT p_partkey, ends_with(upper(p_name), 'RING') AS ends, starts_with(upper(p_name), 'SMALL') AS starts,
  upper(p_name) = 'SMALL RING' AS same FROM part
""")
def _(t):
    c = F.col("p_name")
    return t.part.select(
        "p_partkey", tx.like_side(c, "ring", "before").alias("ends"),
        tx.like_side(c, "small", "after").alias("starts"), tx.like_side(c, "Small Ring", "none").alias("same"),
    )


@check("F13_not_like", "SELECT p_partkey FROM part WHERE NOT contains(upper(p_name), 'RING')")
def _(t):
    return t.part.where(tx.not_like(F.col("p_name"), "ring")).select("p_partkey")


@check("F13_or_like", """
SELECT p_partkey FROM part WHERE contains(upper(p_name), 'E') OR contains(upper(p_type), 'E')
  OR NOT contains(upper(p_brand), '1')
""")
def _(t):
    cols = [F.col("p_name"), F.col("p_type")]
    return t.part.where(tx.or_like(cols, "e") | tx.or_not_like([F.col("p_brand")], "1")).select("p_partkey")


@check("F14_groups", """
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000)
  OR NOT (o_orderpriority = '5-LOW' OR o_custkey > 20)
""")
def _(t):
    a = p.grouped(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000)
    b = p.grouped(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") > 20, op="or", negate=True)
    return t.orders.where(a | b).select("o_orderkey")


@check("F15_search_users", """
SELECT userId, email FROM users WHERE upper(email) LIKE '%99_@%' OR upper(name) LIKE '%99_@%' OR upper(mobile) LIKE '%99_@%'
""")
def _(t):
    return p.search_users(t.users, "99_@").select("userId", "email")


# by trigram postings of every part's texts; one partition is replaced after a change
@check("F11_search_postings", "SELECT p_partkey, p_name FROM part WHERE upper(p_name) LIKE '%RING%' OR upper(p_brand) LIKE '%RING%'")
def _(t):
    path, rows = work_dir(t.spark, "part-postings"), t.part.withColumn("part_no", F.col("p_partkey") % 4)
    postings.store(rows.withColumn("p_name", F.when(F.col("part_no") == 1, "no name").otherwise(F.col("p_name"))), "p_partkey", ["p_name", "p_brand"], "part_no", path)
    postings.store(rows.where("part_no = 1"), "p_partkey", ["p_name", "p_brand"], "part_no", path)
    return postings.search(rows, t.spark.read.parquet(path), "p_partkey", ["p_name", "p_brand"], "ring").select("p_partkey", "p_name")


@check("F15_search_postings", """
SELECT userId, email FROM users WHERE upper(email) LIKE '%R#%99_@EXA%' OR upper(name) LIKE '%R#%99_@EXA%' OR upper(mobile) LIKE '%R#%99_@EXA%'
""")
def _(t):
    path, columns = work_dir(t.spark, "user-postings"), ["email", "name", "mobile"]
    postings.store(t.users, "userId", columns, "roleId", path)
    return postings.search(t.users, t.spark.read.parquet(path), "userId", columns, "r#%99_@exa").select("userId", "email")


@check("F16_active", "SELECT userId, name FROM users WHERE isDeleted = 0")
def _(t):
    return p.active(t.users).select("userId", "name")


@check("F17_login_history", """
SELECT * FROM logins WHERE strftime(createdDtm, '%Y-%m-%d') >= '2024-01-10'
  AND strftime(createdDtm, '%Y-%m-%d') <= '2024-01-20' AND upper(sessionData) LIKE '%U1_"%'
""")
def _(t):
    return p.login_history(t.logins, 0, 'u1_"', "10-01-2024", "20-01-2024")


@check("F17_login_page", """
SELECT userId, sessionData, agentString, createdDtm FROM logins WHERE upper(sessionData) LIKE '%U1%' ORDER BY id DESC LIMIT 10 OFFSET 20
""")
def _(t):
    return p.login_page(t.logins, 0, "u1", offset=20)


@check("F18_optional", "SELECT * FROM logins WHERE userId = 17")
def _(t):
    return p.login_history(t.logins, 17, "", "", "")


@check("F19_recent", """
SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND (SELECT max(ts) FROM events)
""")
def _(t):
    return p.recent(t.events, 7, column="ts").select("event_id", "ts")


@check("F19_recent_fixed", """
SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 DAY AND TIMESTAMP '2024-01-20 12:00:00'
""")
def _(t):
    return p.recent(t.events, 10, "2024-01-20 12:00:00", "ts").select("event_id")


LAYER_SQL = """
  contains(upper(job_name), 'STG') AS is_stg, contains(upper(job_name), 'DIM') AS is_dim,
  regexp_matches(upper(job_name), 'MET|METRIC|FATO|FAT|FACT') AS is_fact,
  coalesce(contains(upper(dimension), 'DW'), FALSE) AS is_dw,
  coalesce(contains(upper(dimension), 'DM'), FALSE) AS is_dm
"""


@check("F20_layer_flags", f"SELECT id, {LAYER_SQL} FROM runs")
def _(t):
    flags = p.layer_flags(t.runs)
    return flags.select("id", *[f"is_{n}" for n in p.LAYER_PATTERNS])


@check("F21_mime_match", "SELECT id FROM tree WHERE mime LIKE 'text/%' OR mime = 'image/png'")
def _(t):
    return t.tree.where(p.mime_match(F.col("mime"), ["text", "image/png"])).select("id")


DISKS = """
SELECT id, hostname AS host, '/mnt/' || job_name AS mount,
  CASE WHEN id % 5 = 0 THEN 'tmpfs' ELSE 'ext4' END AS type,
  CASE WHEN id % 7 = 0 THEN '/dev/loop' || CAST(id % 3 AS {s}) ELSE '/dev/sda' END AS filesystem,
  id * 1024 AS total, id * 512 AS used, id * 512 AS free, CAST(id % 120 AS INT) AS percent FROM {runs}
"""


def disks(t):
    t.runs.createOrReplaceTempView("runlens_runs")
    return t.spark.sql(DISKS.format(s="STRING", runs="runlens_runs"))


DISKS_CTE = "disks AS (" + DISKS.format(s="VARCHAR", runs="runs") + ")"


@check("F22_ignore_rows", """
SELECT id FROM disks WHERE mount NOT IN ('/mnt/pyjob') AND NOT contains(type, 'tmpfs') AND NOT contains(filesystem, '/dev/loop')
""", ctes=DISKS_CTE)
def _(t):
    return p.ignore_rows(disks(t), ["/mnt/pyjob"]).select("id")
