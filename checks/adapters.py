"""Driver tables in the shape of run-log tables.

Each adapter is one list of SQL expressions over a base table. Spark takes them as ``selectExpr``;
the comparison SQL takes the same list as a common table expression. ``STR`` stands for the text
type and ``SECS(n)`` for an interval of n seconds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.tables import scan

AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) AppleWebKit/605.1.15 Version/16.5 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
]

ADAPTERS: dict[str, tuple[str, list[str], str | None]] = {
    "runs": ("events", [
        "event_id AS id",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'ready' WHEN 'click' THEN 'Ready' ELSE 'warning' END AS status",
        "CASE user_id % 8 WHEN 0 THEN 'STG_ORDERS' WHEN 1 THEN 'DIM_CUSTOMER' WHEN 2 THEN 'FACT_SALES' WHEN 3 THEN 'met_margin' WHEN 4 THEN 'FATO_VENDAS' WHEN 5 THEN 'stg_events' WHEN 6 THEN 'pyjob' ELSE 'LOAD_MISC' END AS job_name",
        "CAST(event_id % 4 = 0 AS INT) AS reprocess",
        "'Event ' || event_type || CASE WHEN event_id % 10 = 0 THEN ' 100%_done' ELSE '' END AS event_text",
        "CASE user_id % 5 WHEN 0 THEN 'DW_Master' WHEN 1 THEN 'dw_sales' WHEN 2 THEN 'DM_Finance' WHEN 3 THEN 'OTHER' ELSE NULL END AS dimension",
        "CASE event_id % 6 WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'DEV' WHEN 2 THEN 'QA' WHEN 3 THEN 'UAT' WHEN 4 THEN 'PREPROD' ELSE 'PROD' END AS environment",
        "CAST(CAST(floor(value) AS BIGINT) AS STR) AS records_total",
        "CAST(CAST(floor(value) AS BIGINT) AS STR) AS records_processed",
        "ts AS start_time",
        "ts + SECS(event_id % 5000) AS last_activity",
        "CAST(event_type = 'error' AS INT) AS distict_errors",
        "'host' || CAST(user_id % 16 AS STR) AS hostname",
        "'I' || CAST(CAST(floor(event_id / 3) AS BIGINT) AS STR) AS instance_id",
        "CASE WHEN event_id % 7 = 0 THEN 'msg ' || CAST(event_id AS STR) ELSE NULL END AS msg",
    ], None),
    "runs_o": ("orders", [
        "o_orderkey AS id",
        "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'running' ELSE 'error' END AS status",
        "o_orderpriority AS job_name",
        "o_orderdate AS last_activity",
    ], None),
    "errs": ("runs", [
        "id", "instance_id AS tmf_id", "job_name", "last_activity AS moment", "'Exception' AS type",
        "'host' AS origin", "'failed ' || job_name AS message", "CAST(id % 7 AS INT) AS code",
    ], "status = 'error'"),
    "users": ("customer", [
        "c_custkey + 1 AS userId", "lower(c_name) || '@example.com' AS email", "c_name AS name",
        "'+55 ' || CAST(c_custkey * 7919 AS STR) AS mobile",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS groupId",
        "CAST(c_custkey % 3 + 1 AS INT) AS roleId", "CAST(c_custkey % 10 = 0 AS INT) AS isDeleted",
    ], None),
    "user_groups": ("nation", ["n_nationkey AS id", "n_name AS name"], None),
    "roles": ("region", [
        "CAST(r_regionkey + 1 AS INT) AS roleId",
        "CASE r_regionkey WHEN 0 THEN 'System Administrator' WHEN 1 THEN 'Manager' ELSE 'Employee' END AS role",
    ], None),
    "logins": ("events", [
        "event_id AS id", "user_id AS userId",
        "'{\"role\":\"' || CAST(user_id % 3 + 1 AS STR) || '\",\"name\":\"U' || CAST(user_id AS STR) || '\"}' AS sessionData",
        "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS[:3]))
        + f" ELSE '{AGENTS[3]}' END AS agentString",
        "ts AS createdDtm",
    ], None),
    "ctx": ("part", [
        "p_partkey AS Id", "p_size % 5 AS ProjectDetailsFK",
        "p_brand || '-' || CAST(p_size AS STR) AS ContextKey", "p_type AS ContextValue",
        "0 AS isEncrypted", "CAST(p_partkey % 6 AS INT) AS EnvironmentFK", "p_name AS Description",
        "CAST(p_size % 2 = 0 AS INT) AS IsActive",
    ], None),
    "proj": ("region", [
        "r_regionkey AS Id", "r_name AS ProjectName", "CAST(r_regionkey <> 2 AS INT) AS IsActive",
    ], None),
    "env": ("nation", [
        "n_nationkey AS Id",
        "CASE n_nationkey WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'DEV' WHEN 2 THEN 'QA' WHEN 3 THEN 'UAT' WHEN 4 THEN 'PREPROD' ELSE 'PROD' END AS Environment",
        "CAST(n_nationkey <> 2 AS INT) AS IsActive",
    ], None),
    "reports": ("supplier", [
        "s_suppkey AS id", "s_name AS name", "CASE WHEN s_nationkey % 2 = 0 THEN 'dash' ELSE 'page' END AS type",
        "CASE WHEN s_suppkey % 10 = 3 THEN '*' WHEN s_suppkey % 10 = 4 THEN 'Customer#000000001,Customer#000000002' ELSE 'All Users from group' END AS users",
        "CASE s_suppkey % 3 WHEN 0 THEN 'NATION_1' WHEN 1 THEN 'NATION_1,NATION_2' ELSE 'None' END AS groups",
    ], None),
    "builds": ("orders", [
        "o_orderpriority AS job", "o_orderkey AS number",
        "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILURE' ELSE 'ABORTED' END AS result",
        "EPOCH_MS(o_orderdate) AS timestamp",
        "CAST(floor(o_totalprice * 1000) AS BIGINT) AS duration",
    ], None),
    "tree": ("part", [
        "p_partkey + 1 AS id", "CAST(floor((p_partkey + 1) / 4) AS BIGINT) AS parent_id", "p_name AS name",
        "CASE WHEN p_partkey % 2 = 0 THEN 'directory' ELSE 'text/plain' END AS mime",
    ], None),
    "email": ("supplier", [
        "s_suppkey AS id", "'T' || CAST(s_suppkey AS STR) AS name", "'team' || CAST(s_suppkey AS STR) || '@example.com' AS \"to\"",
        "'noreply@example.com' AS \"from\"",
        "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'a@example.com,b@example.com' END AS cc",
        "'Report ' || s_name AS subject", "'Body of ' || s_name AS msg",
        "'SMTP' || CAST(s_nationkey % 7 AS STR) AS smtp",
    ], None),
    "smtp": ("nation", [
        "'SMTP' || CAST(n_nationkey AS STR) AS name", "'mail' || CAST(n_nationkey AS STR) || '.example.com' AS smtp_host",
        "25 + n_nationkey AS smtp_port", "'u' || CAST(n_nationkey AS STR) AS username", "'x' AS password",
        "CAST(n_nationkey % 2 AS INT) AS ssl",
    ], None),
    "job_info": ("part", [
        "p_partkey AS id", "'JOB_' || CAST(p_size AS STR) AS job_name",
        "CASE p_partkey % 5 WHEN 0 THEN 'tFileInputExcel_' WHEN 1 THEN 'tFileInputDelimited_' WHEN 2 THEN 'tFileInputJSON_' WHEN 3 THEN 'tFileInputXML_' ELSE 'tOther_' END || CAST(p_partkey AS STR) AS job_component",
        "CASE p_partkey % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' WHEN 3 THEN '.xml' ELSE 'None' END AS component_type",
        "'in' AS file_path", "replace(p_name, ' ', '_') AS file_name", "CAST(p_partkey % 2 + 1 AS INT) AS file",
        "CAST(p_size % 3 AS INT) AS file_uploaded",
    ], None),
    "begins": ("runs", [
        "id * 2 AS event_id", "start_time AS ts", "'begin' AS kind", "instance_id", "environment", "job_name",
        "event_text", "dimension", "NULL_STR AS records_total", "NULL_STR AS records_processed",
        "NULL_STR AS msg", "NULL_STR AS origin", "CAST(NULL AS INT) AS code",
    ], None),
    "finishes": ("runs", [
        "id * 2 + 1 AS event_id", "last_activity AS ts",
        "CASE WHEN status = 'error' THEN 'error' ELSE 'end' END AS kind", "instance_id", "environment", "job_name",
        "NULL_STR AS event_text", "NULL_STR AS dimension",
        "CASE WHEN status = 'error' THEN NULL ELSE records_total END AS records_total",
        "CASE WHEN status = 'error' THEN NULL ELSE records_processed END AS records_processed",
        "msg", "CASE WHEN status = 'error' THEN 'method' ELSE NULL END AS origin",
        "CASE WHEN status = 'error' THEN CAST(id % 7 AS INT) ELSE NULL END AS code",
    ], "lower(status) IN ('ready', 'error')"),
}

UNIONS = {"run_events": ["begins", "finishes"]}

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _spark_text(text: str) -> str:
    text = re.sub(r"SECS\(([^()]*)\)", r"make_dt_interval(0, 0, 0, \1)", text)
    text = re.sub(r"EPOCH_MS\(([^()]*)\)", r"CAST(CAST(CAST(\1 - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000 AS BIGINT)", text)
    text = text.replace('"to"', "`to`").replace('"from"', "`from`")
    return text.replace("NULL_STR", "CAST(NULL AS STRING)").replace("AS STR)", "AS STRING)")


def _duck_text(text: str) -> str:
    text = re.sub(r"SECS\(([^()]*)\)", r"to_seconds(\1)", text)
    text = re.sub(r"EPOCH_MS\(([^()]*)\)", r"epoch_ms(\1)", text)
    return text.replace("NULL_STR", "CAST(NULL AS VARCHAR)").replace("AS STR)", "AS VARCHAR)")


def run_events(runs: DataFrame) -> DataFrame:
    """Begin and finish events of runs from one scan, batch or stream; its SQL form is a union."""
    begin, failed = F.col("step") == 0, F.col("status") == "error"

    def at(step_is_begin: bool, value: Column, only: Column | None = None) -> Column:
        when = begin if step_is_begin else ~begin
        return F.when(when if only is None else when & only, value)

    steps = F.when(F.lower("status").isin("ready", "error"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return runs.select("*", F.explode(steps).alias("step")).select(
        (F.col("id") * 2 + F.col("step")).alias("event_id"),
        F.when(begin, F.col("start_time")).otherwise(F.col("last_activity")).alias("ts"),
        F.when(begin, "begin").when(failed, "error").otherwise("end").alias("kind"),
        "instance_id", "environment", "job_name",
        at(True, F.col("event_text")).alias("event_text"),
        at(True, F.col("dimension")).alias("dimension"),
        at(False, F.col("records_total"), ~failed).alias("records_total"),
        at(False, F.col("records_processed"), ~failed).alias("records_processed"),
        at(False, F.col("msg")).alias("msg"),
        at(False, F.lit("method"), failed).alias("origin"),
        at(False, (F.col("id") % 7).cast("int"), failed).alias("code"),
    )


def runs_from(events: DataFrame) -> DataFrame:
    """The runs adapter over any event rows, batch or stream."""
    return events.selectExpr(*[_spark_text(e) for e in ADAPTERS["runs"][1]])


class Tables:
    """Driver tables and adapters of one folder as attributes."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name == "run_events":
            return run_events(self.runs)
        if name in ADAPTERS:
            base, exprs, where = ADAPTERS[name]
            df = getattr(self, base)
            if where:
                df = df.where(_spark_text(where))
            return df.selectExpr(*[_spark_text(e) for e in exprs])
        if name in DRIVER_TABLES:
            return scan(self.spark, self.directory, name)
        raise AttributeError(name)


def _definition(name: str) -> str:
    if name in UNIONS:
        return " UNION ALL ".join(f"SELECT * FROM {part}" for part in UNIONS[name])
    base, exprs, where = ADAPTERS[name]
    tail = f" WHERE {_duck_text(where)}" if where else ""
    return f"SELECT {', '.join(_duck_text(e) for e in exprs)} FROM {base}{tail}"


def with_adapters(body: str, recursive: bool = False, ctes: str = "") -> str:
    """Comparison SQL with the definitions of all adapters it names put in front."""
    order = [*ADAPTERS, *UNIONS]
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(_definition(name))

    need(body + " " + ctes)
    parts = [f"{name} AS ({_definition(name)})" for name in order if name in needed]
    if ctes:
        parts.append(ctes)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
