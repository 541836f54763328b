"""Table changes, run lifecycle (batch and stream), validation, agents, jobs, trees and hosts."""

from pyspark.sql import functions as F

from runlens.operators import agents, changes, hosts, jobs, lifecycle, tree, validation
from runlens.session import work_dir
from runlens.streaming import lifecycle as live
from runlens.streaming import run_fold, run_state

from .adapters import run_events, runs_from
from .registry import check
from .tables_checks import DISKS_CTE, disks

# ---------------------------------------------------------------- table changes

CHANGES = "SELECT c_custkey AS o_custkey, c_mktsegment AS o_orderpriority, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS o_totalprice FROM customer WHERE c_custkey % 3 = 0"


def change_rows(t):
    return t.customer.where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderpriority"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("o_totalprice"),
    )


@check("M1_update_by_key", f"""
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, CASE WHEN c.o_custkey IS NULL THEN o.o_totalprice ELSE c.o_totalprice END AS o_totalprice,
  o.o_orderdate, CASE WHEN c.o_custkey IS NULL THEN o.o_orderpriority ELSE c.o_orderpriority END AS o_orderpriority
FROM orders o LEFT JOIN ({CHANGES}) c ON c.o_custkey = o.o_custkey
""")
def _(t):
    return changes.update_by_key(t.orders, change_rows(t), ["o_custkey"])


@check("M1_update_last_wins", """
SELECT c.c_custkey, c.c_name, coalesce(l.p, c.c_mktsegment) AS c_mktsegment FROM customer c
LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) l ON l.o_custkey = c.c_custkey
""")
def _(t):
    log = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return changes.update_by_key(t.customer.select("c_custkey", "c_name", "c_mktsegment"), log, ["c_custkey"], "o_orderkey")


@check("M2_update_batch", f"""
SELECT o.o_orderkey, o.o_custkey, coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice,
  coalesce(c.o_orderpriority, o.o_orderpriority) AS o_orderpriority
FROM orders o LEFT JOIN ({CHANGES}) c ON c.o_custkey = o.o_custkey
""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return changes.update_batch(rows, change_rows(t), ["o_custkey"])


@check("M3_replace_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_custkey, 'X' FROM orders WHERE o_orderkey % 5 = 0
""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    incoming = rows.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    return changes.replace_rows(rows, incoming, ["o_orderkey"])


@check("M4_delete_rows", "SELECT * FROM runs WHERE NOT (dimension = 'OTHER' AND reprocess = 1) OR dimension IS NULL")
def _(t):
    return changes.delete_rows(t.runs, (F.col("dimension") == "OTHER") & (F.col("reprocess") == 1))


@check("M4_delete_by_table", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(t):
    gone = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return changes.delete_rows(t.orders, keys=gone)


@check("M5_soft_delete", """
SELECT userId, name, CASE WHEN groupId = 7 THEN 1 ELSE isDeleted END AS isDeleted, CASE WHEN groupId = 7 THEN 1 END AS updatedBy,
  CASE WHEN groupId = 7 THEN TIMESTAMP '2024-02-01 10:00:00' END AS updatedDtm FROM users
""")
def _(t):
    gone = t.users.where("groupId = 7").select("userId")
    return changes.soft_delete(t.users.select("userId", "name", "isDeleted"), gone, 1, "2024-02-01 10:00:00")


@check("M6_increment", """
SELECT i.id, i.job_name, i.file_uploaded + coalesce(n, 0) AS file_uploaded FROM job_info i
LEFT JOIN (SELECT l_partkey + 0 AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.id = i.id
""")
def _(t):
    arrivals = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return changes.increment(t.job_info.select("id", "job_name", "file_uploaded"), arrivals, ["id"], "file_uploaded")


@check("M7_copy_rows", """
SELECT p_partkey, p_name, p_brand FROM part UNION ALL SELECT p_partkey + 1000000, p_name, 'COPY' FROM part WHERE p_size < 10
""")
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    copied = changes.copy_rows(rows, F.col("p_size") < 10, p_partkey=F.col("p_partkey") + 1000000, p_brand="COPY")
    return copied.drop("p_size")


@check("M8_cancel_runs", "SELECT id, CASE WHEN status = 'running' THEN 'Cancelled' ELSE status END AS status FROM runs")
def _(t):
    wanted = t.runs.where("status = 'running'").select("id")
    return changes.cancel_runs(t.runs, wanted).select("id", "status")


# ---------------------------------------------------------------- lifecycle

FOLD_SQL = """
SELECT id, instance_id, environment, job_name,
  CASE lower(status) WHEN 'ready' THEN 'ready' WHEN 'error' THEN 'error' ELSE 'running' END AS status,
  CASE WHEN status = 'error' THEN 'Error(s) Found' ELSE event_text END AS event_text, dimension,
  CASE WHEN lower(status) = 'ready' THEN records_total ELSE '0' END AS records_total,
  CASE WHEN lower(status) = 'ready' THEN records_processed ELSE '0' END AS records_processed, start_time,
  CASE WHEN lower(status) IN ('ready', 'error') THEN last_activity ELSE start_time END AS last_activity,
  CASE WHEN lower(status) = 'ready' THEN msg END AS msg, CASE WHEN status = 'error' THEN 1 END AS distict_errors,
  CASE WHEN status = 'error' THEN '0' END AS warnings, CAST(1 AS BIGINT) AS n_begin, FALSE AS ambiguous FROM runs
"""
FOLD_ONE = f"SELECT * EXCLUDE (id) FROM ({FOLD_SQL})"


@check("L1_begin_rows", """
SELECT instance_id, environment, job_name, '1' AS interface_id, 'running' AS status, event_text, dimension, 0 AS reprocess,
  '0' AS records_total, '0' AS records_processed, start_time, start_time AS last_activity, NULL::VARCHAR AS no_running_time,
  NULL::INT AS distict_errors, NULL::VARCHAR AS warnings, 'host' || CAST(id % 5 AS VARCHAR) AS hostname, NULL::VARCHAR AS username,
  NULL::VARCHAR AS msg FROM runs
""")
def _(t):
    host = F.concat(F.lit("host"), (F.floor(F.col("event_id") / 2) % 5).cast("string"))
    rows = lifecycle.begin_rows(t.run_events.withColumn("hostname", host))
    return rows.withColumn("no_running_time", F.col("running_time").cast("string")).drop("running_time")


@check("L2_fold_runs", FOLD_ONE)
def _(t):
    return lifecycle.fold_runs(t.run_events)


# Three runs share a key here, so most updates find several rows or none.
SHARED = "SELECT * REPLACE ('pyjob' AS job_name, 'PROD' AS environment) FROM run_events"
EXACT_SQL = """
SELECT b.instance_id, b.environment, b.job_name,
  CASE WHEN u.last_kind = 'end' THEN 'ready' WHEN u.last_kind = 'error' THEN 'error' ELSE 'running' END AS status,
  CASE WHEN u.n_error > 0 THEN 'Error(s) Found' ELSE b.event_text END AS event_text, b.dimension,
  coalesce(u.total, '0') AS records_total, coalesce(u.processed, '0') AS records_processed, b.ts AS start_time,
  greatest(b.ts, coalesce(u.last_ts, b.ts)) AS last_activity, u.msg,
  CASE WHEN u.n_error > 0 THEN 1 END AS distict_errors, CASE WHEN u.n_error > 0 THEN '0' END AS warnings,
  b.n AS n_begin, b.n > 1 AS ambiguous
FROM b LEFT JOIN (
  SELECT run, max(ts) AS last_ts, arg_max(kind, (ts, event_id)) AS last_kind,
    arg_max(records_total, (ts, event_id)) FILTER (kind = 'end') AS total,
    arg_max(records_processed, (ts, event_id)) FILTER (kind = 'end') AS processed,
    arg_max(coalesce(msg, chr(1)), (ts, event_id)) FILTER (kind = 'end') AS m, nullif(m, chr(1)) AS msg,
    count(*) FILTER (kind = 'error') AS n_error
  FROM (SELECT e.*, (SELECT b.event_id FROM b WHERE b.instance_id = e.instance_id AND (b.ts, b.event_id) < (e.ts, e.event_id)
          ORDER BY b.ts, b.event_id LIMIT 1) AS run FROM shared e
        WHERE e.kind <> 'begin' AND (SELECT count(*) FROM b WHERE b.instance_id = e.instance_id AND (b.ts, b.event_id) < (e.ts, e.event_id)) = 1)
  GROUP BY run) u ON u.run = b.event_id
"""
EXACT_CTE = f"shared AS ({SHARED}), b AS (SELECT *, count(*) OVER (PARTITION BY instance_id) AS n FROM shared WHERE kind = 'begin')"


def shared_events(t):
    spelled = F.when(F.col("kind") == "begin", "PROD").otherwise("prod")  # keys meet without regard to case
    return t.run_events.withColumn("job_name", F.lit("pyjob")).withColumn("environment", spelled)


@check("L2_fold_runs_exact", EXACT_SQL, ctes=EXACT_CTE)
def _(t):
    return lifecycle.fold_runs(shared_events(t))


@check("L3_error_rows", """
SELECT instance_id AS tmf_id, job_name, last_activity AS moment, 'Python Exception' AS type, 'method' AS origin, msg AS message,
  CAST(id % 7 AS INT) AS code FROM runs WHERE status = 'error'
""")
def _(t):
    return lifecycle.error_rows(t.run_events)


# errors of keys with several runs count only between the first and the second begin, orphans never
@check("L3_error_rows_shared", """
SELECT e.instance_id AS tmf_id, e.job_name, e.ts AS moment, e.code FROM shared e WHERE e.kind = 'error' AND e.event_id % 5 <> 0
  AND (SELECT count(*) FROM b WHERE b.instance_id = e.instance_id AND (b.ts, b.event_id) < (e.ts, e.event_id)) = 1
UNION ALL SELECT 'orphan', 'pyjob', ts, code FROM shared WHERE FALSE
""", ctes=EXACT_CTE)
def _(t):
    events = shared_events(t).where("kind <> 'error' OR event_id % 5 <> 0")
    orphans = shared_events(t).where("kind = 'error' AND event_id % 5 = 0").withColumn("instance_id", F.lit("orphan"))
    return lifecycle.error_rows(events.unionByName(orphans)).select("tmf_id", "job_name", "moment", "code")


@check("L4_stuck_absolute", """
SELECT id, job_name FROM runs WHERE upper(status) = 'RUNNING' AND start_time < (SELECT max(last_activity) FROM runs) - INTERVAL 6000 MINUTE
""")
def _(t):
    return lifecycle.stuck_runs(t.runs, "absolute", 6000).select("id", "job_name")


@check("L4_stuck_no_activity", """
SELECT id, job_name FROM runs WHERE upper(status) = 'RUNNING' AND last_activity < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3600 SECOND
""")
def _(t):
    return lifecycle.stuck_runs(t.runs, "no_activity", 3600, "2024-01-20 00:00:00").select("id", "job_name")


@check("L7_notifications", """
SELECT r.id, r.job_name, o.outcome, m.name AS template,
  m."to" || CASE WHEN m.cc <> '' THEN ', cc:' || replace(m.cc, ',', ', cc:') ELSE '' END AS recipients,
  m."from" AS sender, m.subject, m.msg AS body, s.smtp_host, s.smtp_port
FROM (SELECT *, CASE upper(status) WHEN 'READY' THEN 'success' WHEN 'ERROR' THEN 'failure' WHEN 'CANCELLED' THEN 'abort' END AS outcome FROM runs) r
JOIN (SELECT job_name, outcome, template FROM (
  SELECT DISTINCT job_name, 'T' || length(job_name) AS s, CASE WHEN job_name LIKE 'STG%' THEN '0' ELSE 'T3' END AS f FROM runs)
  CROSS JOIN LATERAL (VALUES ('success', s), ('failure', f), ('abort', '0')) v(outcome, template) WHERE template <> '0') o
  ON o.job_name = r.job_name AND o.outcome = r.outcome
JOIN email m ON m.name = o.template JOIN smtp s ON s.name = m.smtp
""")
def _(t):
    chosen = t.runs.select("job_name").distinct().select(
        "job_name", F.concat(F.lit("T"), F.length("job_name").cast("string")).alias("on_success"),
        F.when(F.col("job_name").startswith("STG"), "0").otherwise("T3").alias("on_failure"), F.lit("0").alias("on_abort"),
    )
    return lifecycle.notifications(t.runs, chosen, t.email, t.smtp)


def job_templates(t):
    """Template of each job and outcome."""
    return t.runs.select("job_name").distinct().select(
        "job_name", F.concat(F.lit("T"), F.length("job_name").cast("string")).alias("on_success"),
        F.when(F.col("job_name").startswith("STG"), "0").otherwise("T3").alias("on_failure"), F.lit("0").alias("on_abort"),
    )


# ---------------------------------------------------------------- streams over the event file


def event_stream(t):
    """The run events as a stream that reads the event file."""
    source = live.read_events(t.spark, t.directory, t.events.schema, "events.parquet")
    return run_events(runs_from(source)).withColumn("ts", F.col("ts").cast("timestamp"))


def late_stream(t, events, parts=4):
    """Events as a stream of one part a micro-batch, in time order but for a tenth that come a part or two later. A part
    is one file, or one for every 50,000 rows, so that several tasks write and read it."""
    path = work_dir(t.spark, "event-files")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = F.unix_micros("ts") / 1e6
    ends = events.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high"), F.count(F.lit(1)).alias("rows")).first()
    span = max(ends["high"] - ends["low"], 1.0)
    part = F.floor((seconds - ends["low"]) / span * parts) + F.when(F.pmod(F.hash("event_id"), F.lit(10)) == 0, F.lit(1) + F.col("event_id") % 2).otherwise(0)
    placed = events.withColumn("part", F.least(part, F.lit(parts - 1)))
    files = max(1, ends["rows"] // (50_000 * parts))
    for i in range(parts):
        placed.where(F.col("part") == i).drop("part").repartition(files).write.mode("append").parquet(path)
    return live.read_events(t.spark, path, events.schema, files_per_batch=files)


def run_tables(t, stream, name, **options):
    """The tables that the lifecycle stream keeps."""
    path = work_dir(t.spark, name)
    live.start_available(stream, run_fold.tables_writer(path, **options), work_dir(t.spark, name + "-state")).awaitTermination()
    return path


def run_stream(t, df, name, mode="append"):
    path = work_dir(t.spark, name)
    live.start_available(df, live.batch_writer(path), work_dir(t.spark, name + "-state"), mode).awaitTermination()
    return live.read_batches(t.spark, path, df.schema)


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@check("L1_begin_stream", """
SELECT instance_id, environment, job_name, 'running' AS status, event_text, dimension, start_time FROM runs
""")
def _(t):
    rows = run_stream(t, live.begin_stream(event_stream(t)), "begin")
    return _ntz(rows.select("instance_id", "environment", "job_name", "status", "event_text", "dimension", "start_time"), "start_time")


@check("L2_fold_stream", FOLD_ONE)
def _(t):
    return _ntz(run_fold.current_runs(t.spark, run_tables(t, event_stream(t), "fold")).drop("begin_id"), "start_time", "last_activity")


# several begins a key, two spellings, and files that come too late: the log repairs what the state can't know
@check("L2_fold_stream_shared", EXACT_SQL, ctes=EXACT_CTE)
def _(t):
    events = shared_events(t)
    path = run_tables(t, late_stream(t, events), "fold-shared")
    return _ntz(run_state.repair(t.spark, path, events, run_fold.current_runs(t.spark, path)), "start_time", "last_activity")


# A stream emits errors and missing ends only once its watermark (latest event less 10 minutes) has passed.
@check("L3_error_stream", """
SELECT instance_id AS tmf_id, job_name, last_activity AS moment, CAST(id % 7 AS INT) AS code FROM runs
WHERE status = 'error' AND last_activity < (SELECT max(ts) FROM run_events) - INTERVAL 10 MINUTE
""")
def _(t):
    rows = run_fold.error_rows(t.spark, run_tables(t, late_stream(t, t.run_events), "errors"))
    return _ntz(rows.select("tmf_id", "job_name", "moment", "code"), "moment")


STUCK_SQL = f"""
SELECT instance_id, environment, job_name, start_time FROM ({FOLD_SQL})
WHERE status = 'running' AND start_time + INTERVAL {{}} SECOND < (SELECT max(ts) FROM run_events) - INTERVAL 10 MINUTE
"""


@check("L4_stuck_stream", STUCK_SQL.format(3600))
def _(t):
    return _ntz(run_state.open_stuck(t.spark, run_tables(t, event_stream(t), "stuck")), "start_time")


# ends that come two files late take their reports back
@check("L4_stuck_late", STUCK_SQL.format(3600))
def _(t):
    return _ntz(run_state.open_stuck(t.spark, run_tables(t, late_stream(t, t.run_events), "stuck-late")), "start_time")


@check("L4_silent_stream", STUCK_SQL.format(5400).replace("start_time FROM", "start_time AS last_activity FROM"))
def _(t):
    path = run_tables(t, event_stream(t), "silent", stuck_seconds=5400)
    return _ntz(run_state.open_stuck(t.spark, path).withColumnRenamed("start_time", "last_activity"), "last_activity")


@check("L5_live_status", f"SELECT status, count(*) AS amount FROM ({FOLD_SQL}) GROUP BY status")
def _(t):
    return run_state.status_counts(t.spark, run_tables(t, event_stream(t), "live"))


@check("L5_live_status_table", f"SELECT status, count(*) AS amount FROM ({FOLD_SQL}) GROUP BY status")
def _(t):
    path = run_tables(t, late_stream(t, t.run_events), "run-table")
    return run_fold.current_runs(t.spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("amount"))


@check("L7_mail_stream", """
SELECT r.id * 2 AS id, r.job_name, o.outcome, m.name AS template,
  m."to" || CASE WHEN m.cc <> '' THEN ', cc:' || replace(m.cc, ',', ', cc:') ELSE '' END AS recipients, s.smtp_host
FROM (SELECT *, CASE upper(status) WHEN 'READY' THEN 'success' WHEN 'ERROR' THEN 'failure' END AS outcome FROM runs) r
JOIN (SELECT job_name, outcome, template FROM (
  SELECT DISTINCT job_name, 'T' || length(job_name) AS s, CASE WHEN job_name LIKE 'STG%' THEN '0' ELSE 'T3' END AS f FROM runs)
  CROSS JOIN LATERAL (VALUES ('success', s), ('failure', f)) v(outcome, template) WHERE template <> '0') o
  ON o.job_name = r.job_name AND o.outcome = r.outcome
JOIN email m ON m.name = o.template JOIN smtp s ON s.name = m.smtp
""")
def _(t):
    path, runs = work_dir(t.spark, "mails"), work_dir(t.spark, "mail-runs")
    keep, write = run_fold.tables_writer(runs), run_state.mail_writer(path, job_templates(t), t.email, t.smtp)

    def twice(batch, batch_id):
        for _ in range(2):  # a batch that runs again
            keep(batch, batch_id)
            write(run_fold.changed_runs(batch.sparkSession, runs), batch_id)

    live.start_available(event_stream(t), twice, work_dir(t.spark, "mails-state")).awaitTermination()
    return t.spark.read.parquet(path).select("id", "job_name", "outcome", "template", "recipients", "smtp_host")


@check("L6_status_months", f"""
SELECT CAST(date_trunc('month', last_activity) AS DATE) AS month, status, count(*) AS amount FROM ({FOLD_SQL}) GROUP BY 1, 2
""")
def _(t):
    return run_state.status_counts(t.spark, run_tables(t, late_stream(t, t.run_events), "months"), "month")


@check("L6_daily_stream", """
SELECT CAST(ts AS DATE) AS day, kind, count(*) AS amount FROM run_events GROUP BY 1, 2
""")
def _(t):
    path = work_dir(t.spark, "daily")
    live.start_available(late_stream(t, t.run_events), live.day_counts_writer(path), work_dir(t.spark, "daily-state")).awaitTermination()
    return live.day_counts(t.spark, path).select("day", "kind", "amount")


@check("L8_insert_if_absent", "SELECT DISTINCT job_name, environment FROM runs")
def _(t):
    fresh = live.insert_if_absent_stream(event_stream(t), ["job_name", "environment"], "60 days")
    return run_stream(t, fresh, "absent").select("job_name", "environment")


# a third of the keys lie in the table already, and a batch that runs again changes nothing
@check("L8_insert_absent_table", """
SELECT DISTINCT job_name, environment, CAST(CASE WHEN environment IN ('DEV', 'QA') THEN -1 ELSE 0 END AS BIGINT) AS batch_id FROM runs
""")
def _(t):
    path, keys = work_dir(t.spark, "absent-table"), ["job_name", "environment"]
    rows = t.run_events.select(*keys, "ts")
    write = live.absent_writer(path, keys)
    write(rows.where("environment IN ('DEV', 'QA')"), -1)
    for _ in range(2):
        write(rows, 0)
    write(rows.withColumn("job_name", F.lower("job_name")), 1)
    return live.read_batches(t.spark, path, rows.schema).select(*keys, "batch_id")


# ---------------------------------------------------------------- validation

USER_RULES = {
    "name": ["required", ("max_length", 18), ("is_unique",)],
    "email": ["required", "valid_email", ("regex", "[0-9]@")],
    "mobile": ["required", ("min_length", 8), ("differs", "name")],
    "roleId": ["required", "numeric", ("in_list", ["1", "2"])],
    "groupId": ["natural", ("less_than", 20)],
}


@check("V1_violations", """
SELECT userId, 'mobile' AS "column", 'min_length' AS rule FROM users WHERE length(mobile) < 8
UNION ALL SELECT userId, 'roleId', 'in_list' FROM users WHERE roleId NOT IN (1, 2)
UNION ALL SELECT userId, 'groupId', 'less_than' FROM users WHERE groupId >= 20
""")
def _(t):
    return validation.violations(validation.check_rows(t.users, USER_RULES, "userId"), "userId")


@check("V1_accepted", """
SELECT userId, name FROM users WHERE NOT length(mobile) < 8 AND roleId IN (1, 2) AND (groupId IS NULL OR groupId < 20)
""")
def _(t):
    return validation.accepted(validation.check_rows(t.users, USER_RULES, "userId")).select("userId", "name")


@check("V1_unique", """
SELECT p_partkey, 'p_name' AS "column", 'is_unique' AS rule FROM part p
WHERE p_partkey <> (SELECT min(p_partkey) FROM part x WHERE x.p_name = p.p_name)
""")
def _(t):
    checked = validation.check_rows(t.part, {"p_name": [("is_unique",)]}, "p_partkey")
    return validation.violations(checked, "p_partkey")


DOCUMENT_RULES = {
    "text": ["required", ("min_length", 200), ("max_length", 5000), ("regex", r"^[\s\S]*\.\s*$")],
    "lang": [("in_list", ["en", "de", "fr"]), "alpha", ("exact_length", 2)],
    "source": ["alpha_dash"],
}


@check("V1_documents", """
SELECT doc_id, 'text' AS "column", CASE WHEN trim(coalesce(text, '')) = '' THEN 'required' WHEN length(text) < 200 THEN 'min_length'
  WHEN length(text) > 5000 THEN 'max_length' ELSE 'regex' END AS rule FROM documents
WHERE trim(coalesce(text, '')) = '' OR length(text) < 200 OR length(text) > 5000 OR NOT regexp_matches(text, '\\.\\s*$')
UNION ALL SELECT doc_id, 'lang', 'in_list' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT doc_id, 'source', 'alpha_dash' FROM documents WHERE source <> '' AND NOT regexp_matches(source, '^[A-Za-z0-9_-]+$')
""")
def _(t):
    return validation.violations(validation.check_rows(t.documents, DOCUMENT_RULES, "doc_id"), "doc_id")


@check("V1_violation_counts", """
SELECT "column", rule, count(*) AS amount FROM (
  SELECT 'text' AS "column", 'min_length' AS rule FROM documents WHERE text <> '' AND length(text) < 200
  UNION ALL SELECT 'text', 'max_length' FROM documents WHERE length(text) > 5000
  UNION ALL SELECT 'lang', 'in_list' FROM documents WHERE lang NOT IN ('en', 'fr')) GROUP BY 1, 2
""")
def _(t):
    rules = {"text": [("min_length", 200), ("max_length", 5000)], "lang": [("in_list", ["en", "fr"])]}
    return validation.violation_counts(validation.check_rows(t.documents, rules, "doc_id", first_only=False))


# ---------------------------------------------------------------- agents and sessions

_AGENT = "CASE id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
PLATFORM = _AGENT.format("'Windows 10'", "'iOS'", "'Linux'", "'Unknown Platform'")
BROWSER = _AGENT.format("'Chrome'", "'Safari'", "'Firefox'", "NULL")
VERSION = _AGENT.format("'119.0.0.0'", "'604.1'", "'115.0'", "NULL")
ROBOT = _AGENT.format("NULL", "NULL", "NULL", "'Googlebot'")
MOBILE = _AGENT.format("NULL", "'Apple iPhone'", "NULL", "NULL")


@check("V2_classify_agents", f"""
SELECT id, {PLATFORM} AS platform_name, {ROBOT} AS robot, {BROWSER} AS browser, {VERSION} AS version, {MOBILE} AS mobile,
  CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END AS is_mobile,
  CASE WHEN id % 4 = 3 THEN 'Googlebot' ELSE {BROWSER} || ' ' || {VERSION} END AS agent_label FROM logins
""")
def _(t):
    return agents.classify_agents(t.logins).select(
        "id", "platform_name", "robot", "browser", "version", "mobile", "is_mobile", "agent_label"
    )


@check("V2_agent_breakdown", f"SELECT {PLATFORM} AS platform_name, {BROWSER} AS browser, count(*) AS logins FROM logins GROUP BY 1, 2")
def _(t):
    return agents.agent_breakdown(t.logins)


@check("V3_expand_sessions", """
SELECT id, userId, json_extract_string(sessionData, '$.role') AS role, json_extract_string(sessionData, '$.roleText') AS roleText,
  json_extract_string(sessionData, '$.name') AS name FROM logins
""")
def _(t):
    return agents.expand_sessions(t.logins).select("id", "userId", "role", "roleText", "name")


@check("V3_logins_per_role_day", """
SELECT json_extract_string(sessionData, '$.role') AS role, CAST(createdDtm AS DATE) AS day, count(*) AS logins FROM logins GROUP BY 1, 2
""")
def _(t):
    return agents.logins_per_role_day(t.logins)


# ---------------------------------------------------------------- job documents, dependencies, catalogue


def job_documents(t):
    """One XML document per part."""
    k = F.col("p_partkey")
    spec = F.when(k % 3 == 0, "@daily").otherwise(F.concat(F.lit("H/"), (k % 60).cast("string"), F.lit(" 4 * * 1")))
    limit = F.when(k % 2 == 0, F.concat(F.lit("<timeoutMinutes>"), (k % 90).cast("string"), F.lit("</timeoutMinutes>"))).otherwise(
        F.concat(F.lit("<timeoutSecondsString>"), (k % 500).cast("string"), F.lit("</timeoutSecondsString>"))
    )
    pieces = [
        "<project><description>", F.col("p_name"), "</description><triggers><hudson.triggers.TimerTrigger><spec>", spec,
        "</spec></hudson.triggers.TimerTrigger></triggers><builders><hudson.tasks.Shell><command>sh /jobs/", F.col("p_brand"),
        ".sh</command></hudson.tasks.Shell></builders><publishers><hudson.tasks.Mailer plugin=\"mailer\"><recipients>ops",
        F.col("p_size").cast("string"), "@example.com</recipients></hudson.tasks.Mailer><hudson.tasks.BuildTrigger><childProjects>job",
        (k * 2 + 1).cast("string"), ",job", (k * 2 + 2).cast("string"),
        "</childProjects><threshold><name>SUCCESS</name><ordinal>0</ordinal></threshold></hudson.tasks.BuildTrigger>",
        "<hudson.plugins.emailext.ExtendedEmailPublisher><configuredTriggers><hudson.plugins.emailext.plugins.trigger.FailureTrigger>",
        "<email><recipientList>", F.lower("p_type"), "@example.com</recipientList><subject>failed</subject></email>",
        "</hudson.plugins.emailext.plugins.trigger.FailureTrigger></configuredTriggers><from>noreply@example.com</from>",
        "</hudson.plugins.emailext.ExtendedEmailPublisher></publishers><buildWrappers>",
        "<hudson.plugins.build__timeout.BuildTimeoutWrapper><strategy class=\"s\">", limit,
        "</strategy></hudson.plugins.build__timeout.BuildTimeoutWrapper></buildWrappers></project>",
    ]
    xml = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in pieces])
    return t.part.select(F.concat(F.lit("job"), k.cast("string")).alias("job"), xml.alias("xml"))


@check("V4_extract_jobs", """
SELECT 'job' || p_partkey AS job, p_name AS description, 'sh /jobs/' || p_brand || '.sh' AS command,
  CASE WHEN p_partkey % 3 = 0 THEN '@daily' ELSE 'H/' || (p_partkey % 60) || ' 4 * * 1' END AS spec,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 90 AS INT) END AS timeout_minutes,
  CASE WHEN p_partkey % 2 = 1 THEN CAST(p_partkey % 500 AS INT) END AS timeout_seconds,
  'job' || (p_partkey * 2 + 1) || ',job' || (p_partkey * 2 + 2) AS children, 'SUCCESS' AS threshold,
  'ops' || p_size || '@example.com' AS recipients, 'noreply@example.com' AS mail_from,
  CAST(NULL AS VARCHAR) AS success_to, CAST(NULL AS VARCHAR) AS success_subject,
  lower(p_type) || '@example.com' AS failure_to, 'failed' AS failure_subject,
  CAST(NULL AS VARCHAR) AS aborted_to, CAST(NULL AS VARCHAR) AS aborted_subject,
  CASE WHEN p_partkey % 3 <> 0 THEN 'H/' || (p_partkey % 60) END AS minute, CASE WHEN p_partkey % 3 <> 0 THEN '4' END AS hour,
  CASE WHEN p_partkey % 3 <> 0 THEN '*' END AS day_of_month, CASE WHEN p_partkey % 3 <> 0 THEN '*' END AS month,
  CASE WHEN p_partkey % 3 <> 0 THEN '1' END AS day_of_week, CASE WHEN p_partkey % 3 = 0 THEN '@daily' END AS tag FROM part
""")
def _(t):
    return jobs.extract_jobs(job_documents(t))


@check("V5_job_closure", "SELECT job, min(depth) AS depth FROM walk GROUP BY job", recursive=True, ctes="""
edges AS (SELECT 'job' || p_partkey AS job, unnest(['job' || (p_partkey * 2 + 1), 'job' || (p_partkey * 2 + 2)]) AS child FROM part),
walk AS (SELECT child AS job, 1 AS depth FROM edges WHERE job = 'job0' UNION ALL
  SELECT e.child, w.depth + 1 FROM edges e JOIN walk w ON e.job = w.job)
""")
def _(t):
    edges = tree.child_edges(jobs.extract_jobs(job_documents(t)).select("job", "children"))
    return tree.job_closure(edges, "job0")


_DIRS = """
dirs AS (SELECT id, name AS path FROM tree WHERE id = 1 UNION ALL
  SELECT t.id, w.path || '/' || t.name FROM tree t JOIN dirs w ON t.parent_id = w.id WHERE t.mime = 'directory')
"""


@check("V6_list_dir", """
SELECT f.id, f.name, CASE WHEN f.id IN (SELECT parent_id FROM tree WHERE mime = 'directory') THEN 1 ELSE 0 END AS dirs
FROM tree f WHERE f.parent_id = 5
""")
def _(t):
    return tree.list_dir(t.tree, 5).select("id", "name", "dirs")


@check("V6_search_below", """
SELECT t.id, t.name, d.path || '/' || t.name AS path FROM tree t JOIN dirs d ON t.parent_id = d.id
WHERE contains(upper(t.name), 'RING') AND t.id <> 1
""", recursive=True, ctes=_DIRS)
def _(t):
    return tree.search_tree(t.tree, 1, "ring").select("id", "name", "path")


@check("V6_search_mime", "SELECT id, name FROM tree WHERE mime LIKE 'text/%'")
def _(t):
    return tree.search_tree(t.tree, mimes=["text"]).select("id", "name")


# ---------------------------------------------------------------- hosts


def _size(x):
    kb = lambda n: f"regexp_replace(CAST(CAST(round({x} / {n}::DOUBLE, 2) AS DECIMAL(24, 2)) AS VARCHAR), '\\.?0+$', '')"
    return (
        f"CASE WHEN {x} > 1073741824 THEN {kb(1073741824)} || ' GB' WHEN {x} > 1048576 THEN {kb(1048576)} || ' MB' "
        f"WHEN {x} > 1024 THEN {kb(1024)} || ' KB' ELSE {x} || ' B' END"
    )


@check("H1_host_utilisation", f"""
SELECT id, {_size('(f * 1024)')} AS free_size, {_size('((total - f) * 1024)')} AS used_size, {_size('(total * 1024)')} AS total_size,
  CAST(CASE WHEN total > 0 THEN 100 - floor(f / CAST(total AS DOUBLE) * 100 + 0.5) ELSE 0 END AS BIGINT) AS percent_used,
  least(CAST(trunc(load * 100 / 4) AS BIGINT), 100) AS load_percent
FROM (SELECT event_id AS id, event_id % 700 + user_id * 3 + 10 AS f, event_id % 700 + user_id * 3 + 10 + user_id * 1000 AS total, value / 100 AS load FROM events)
""")
def _(t):
    samples = t.events.selectExpr(
        "event_id AS id", "event_id % 700 AS free", "user_id * 3 AS buffers", "CAST(10 AS BIGINT) AS cached",
        "event_id % 700 + user_id * 3 + 10 + user_id * 1000 AS total", "value / 100 AS load", "4 AS cores",
    )
    return hosts.host_utilisation(samples).select(
        "id", "free_size", "used_size", "total_size", "percent_used", "load_percent"
    )


@check("H1_disk_usage", f"""
SELECT host, mount, id, least(percent, 100) AS percent, {_size('(total * 1024)')} AS total_size FROM disks d
WHERE id = (SELECT min(x.id) FROM disks x WHERE x.host = d.host AND x.mount = d.mount AND x.type <> 'tmpfs' AND NOT contains(x.filesystem, '/dev/loop'))
""", ctes=DISKS_CTE)
def _(t):
    return hosts.disk_usage(disks(t), "id").select("host", "mount", "id", "percent", "total_size")
