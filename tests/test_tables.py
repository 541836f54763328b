"""Sources, sinks, table changes, contexts, access, trees, builds."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import rows
from runlens.operators import access, builds, changes, context, joins, tree
from runlens.session import shared_dir
from runlens.sources import builds as feed
from runlens.sources import exports, registry, tables as tb


# ---------------------------------------------------------------- sources and sinks


def test_jdbc_options():
    base = {"login": "u", "password": "p", "address": "h", "port": "1", "schema": "s", "oracle_sid": "X",
            "oracle_ServiceName": "Y", "additional_parameters": ""}
    assert registry.jdbc_options({**base, "db_type": "general"}) == {"url": "jdbc:mariadb://h:1/s", "user": "u", "password": "p"}
    assert registry.jdbc_options({**base, "db_type": "oracle_sid"})["url"] == "jdbc:oracle:thin:@h:1:X"
    assert registry.jdbc_options({**base, "db_type": "oracle_ServiceName"})["url"] == "jdbc:oracle:thin:@//h:1/Y"
    extra = {**base, "db_type": "general", "additional_parameters": "a=b"}
    assert registry.jdbc_options(extra, "postgresql")["url"] == "jdbc:postgresql://h:1/s?a=b"
    with pytest.raises(ValueError):
        registry.jdbc_options({**base, "db_type": "other"})


@pytest.mark.parametrize("kind", [".csv", ".json", ".xml"])
def test_registered_files_round_trip(spark, tables, tmp_path, kind):
    entry = {"component_type": kind, "path": str(tmp_path / "f")}
    data = tables.nation
    registry.write_output(data, entry)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    assert rows(registry.read_input(spark, entry, schema)) == rows(data)


def test_excel_is_refused(spark, tables):
    for entry in ({"component_type": ".xlsx", "path": "x"}, {"component_type": "None", "path": "x"}):
        with pytest.raises(ValueError):
            registry.read_input(spark, entry)
        with pytest.raises(ValueError):
            registry.write_output(tables.nation, entry)


def test_csv_quotes_every_field(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', 1), (None, 2)], "a string, b int").coalesce(1)
    exports.export_csv(df, str(tmp_path / "c"), ";")
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines == ['"a";"b"', '"say ""hi""";"1"', '"";"2"']


def test_xml_escapes(spark, tmp_path):
    df = spark.createDataFrame([("a<b & c",)], "t string")
    exports.export_xml(df, str(tmp_path / "x"), "list", "item")
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert "<list>" in text and "<item>" in text and "a&lt;b &amp; c" in text


def test_json_lines_keep_nulls(spark, tmp_path):
    exports.export_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":1,"b":null}']


def test_feed_documents(spark, tmp_path):
    one = '{"name":"a","builds":[{"number":2,"timestamp":0,"duration":5,"result":"SUCCESS"},{"number":1,"timestamp":0,"duration":5,"result":null}]}'
    path = str(tmp_path / "f")
    spark.createDataFrame([('{"jobs":[' + one + ',{"name":"b","builds":[]}]}',)], "value string").write.text(path)
    assert rows(feed.read_feed_documents(spark, path), "job", "number", "result") == [("a", 1, None), ("a", 2, "SUCCESS")]
    wide = spark.createDataFrame([('{"builds":[{"number":3,"fullDisplayName":"x #3","building":true}]}',)], "json string")
    assert rows(feed.wide_builds_from_text(wide), "number", "building") == [(3, True)]


def test_catalogue(spark, tables):
    assert rows(tb.describe(tables.region), "position", "name", "type") == [(0, "r_regionkey", "int"), (1, "r_name", "string")]
    tables.region.createOrReplaceTempView("region_view")
    assert "region_view" in tb.table_names(spark) and tb.table_exists(spark, "region_view")
    assert not tb.table_exists(spark, "no_such_view")
    with pytest.raises(ValueError):
        tb.query(spark, "SELECT ?", [])


def test_only_touched_partitions_change(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(100).select("id", (F.col("id") % 5).alias("part"), F.lit("old").alias("v"))
    tb.rewrite_partitions(table, path, ["part"])
    change = spark.createDataFrame([(7, 2, "new")], "id long, part long, v string")
    stored = spark.read.parquet(path)
    touched = tb.touched_partitions(stored, change, ["part"])
    assert touched.select("part").distinct().count() == 1
    tb.rewrite_partitions(changes.update_by_key(touched.select("id", "part", "v"), change.drop("part"), ["id"]), path, ["part"])
    after = spark.read.parquet(path)
    assert after.count() == 100 and rows(after.where("v = 'new'"), "id") == [(7,)]


def test_files_are_counted_by_name(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x")
    assert rows(registry.landing_counts(registry.list_files(spark, str(tmp_path), "*.csv"))) == [("a.csv", 1), ("b.csv", 1)]


class FakeSession:
    """Only what ``shared_dir`` asks a session for."""

    def __init__(self, master, **conf):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=conf.get, set=conf.__setitem__)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(FakeSession("yarn", **{"spark.checkpoint.dir": "hdfs://x/cp"})) == "hdfs://x/cp"
    assert shared_dir(FakeSession("local[2]", **{"spark.checkpoint.dir": "/tmp/cp"})) == "/tmp/cp"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local) and shared_dir(local).startswith("/tmp/run-")


# ---------------------------------------------------------------- changes


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, None, 30)], "id int, name string, n int")


def test_null_is_set_by_key_but_kept_in_batch(spark, base):
    change = spark.createDataFrame([(1, None), (2, 5)], "id int, n int")
    assert rows(changes.update_by_key(base, change, ["id"]), "id", "n") == [(1, None), (2, 5), (3, 30)]
    assert rows(changes.update_batch(base, change, ["id"]), "id", "n") == [(1, 10), (2, 5), (3, 30)]


def test_replace_twice_is_replace_once(spark, base):
    new = spark.createDataFrame([(2, "x", 0), (9, "y", 1)], "id int, name string, n int")
    once = changes.replace_rows(base, new, ["id"])
    assert rows(once) == rows(changes.replace_rows(once, new, ["id"]))
    assert [r[0] for r in rows(once)] == [1, 2, 3, 9]


def test_delete_counts_and_keeps_unknown(base):
    seen = Observation()
    left = changes.delete_rows(base, F.col("n") > 15, affected=seen)
    assert rows(left, "id") == [(1,), (2,)] and seen.get == {"deleted": 1}


def test_increment_and_soft_delete(spark, base):
    arrivals = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert rows(changes.increment(base, arrivals, ["id"], "n"), "id", "n") == [(1, 12), (2, 1), (3, 30)]
    users = spark.createDataFrame([(1, 0), (2, 0)], "userId int, isDeleted int")
    assert rows(changes.soft_delete(users, [2], 9, "2024-01-01 00:00:00"), "userId", "isDeleted", "updatedBy") == [(1, 0, None), (2, 1, 9)]


def test_cancel_and_copy(spark, base):
    runs = spark.createDataFrame([(1, "running"), (2, "ready")], "id int, status string")
    assert rows(changes.cancel_runs(runs, [1])) == [(1, "Cancelled"), (2, "ready")]
    assert rows(changes.copy_rows(base, F.col("id") == 1, id=8), "id", "name") == [(1, "a"), (2, "b"), (3, None), (8, "a")]


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("k1",)], "k string")
    new = spark.createDataFrame([("k1", 1), ("k2", 3), ("k2", 2), (None, 4)], "k string, n int")
    assert rows(joins.new_rows(new, old, ["k"], "n"), "k", "n") == sorted([("k2", 2), (None, 4)], key=repr)
    assert joins.taken_by_other(spark.createDataFrame([(1, "A@x")], "id int, mail string"), "mail", "a@X", "id", 1).isEmpty()


# ---------------------------------------------------------------- contexts and access


@pytest.fixture(scope="module")
def ctx(spark):
    cols = "Id int, ProjectDetailsFK int, ContextKey string, ContextValue string, isEncrypted int, EnvironmentFK int, Description string, IsActive int"
    c = spark.createDataFrame([
        (1, 1, "rows", "100", 0, 1, "", 1), (2, 1, "Custom", "local text", 0, 1, "", 1), (3, 1, "Custom", "dev text", 0, 2, "", 0),
        (4, 2, "ROWS", "7", 0, 2, "", 1), (5, 1, "rows", "8", 0, 2, "", 1)], cols)
    env = spark.createDataFrame([(1, "LOCAL", 1), (2, "DEV", 1)], "Id int, Environment string, IsActive int")
    proj = spark.createDataFrame([(1, "PoC", 1), (2, "Other", 0)], "Id int, ProjectName string, IsActive int")
    return c, env, proj


def test_context_is_unique_or_null(ctx):
    got = context.resolve_context(*ctx)
    assert rows(got, "context_key", "Environment", "n_matches", "context_value") == [
        ("CUSTOM", "DEV", 1, "dev text"), ("CUSTOM", "LOCAL", 1, "local text"),
        ("ROWS", "DEV", 2, None), ("ROWS", "LOCAL", 1, "100")]
    assert rows(context.resolve_context(*ctx, environment="dev", project="poc", active_only=True), "context_key", "context_value") == [("ROWS", "8")]
    assert rows(context.context_matrix(*ctx, environments=["LOCAL", "DEV"])) == [("CUSTOM", "local text", "dev text"), ("ROWS", "100", None)]


@pytest.fixture(scope="module")
def who(spark):
    reports = spark.createDataFrame([
        (1, "R1", "t", "All Users from group", "Dev"), (2, "R2", "t", "All Users from group", "Dev,Ops"),
        (3, "R3", "t", "*", "None"), (4, "R4", "t", "ann,bob", "None")], "id int, name string, type string, users string, groups string")
    users = spark.createDataFrame([("ann", 1), ("bob", 2), ("ann", 2), ("eve", None)], "name string, groupId int")
    groups = spark.createDataFrame([(1, "dev"), (2, "Ops")], "id int, name string")
    return reports, users, groups


def test_reference_and_strict_access(who):
    names = lambda user, mode: [r[0] for r in rows(access.visible_reports(*who, user, mode), "name")]
    assert names("ann", "reference") == ["R1", "R3"]
    assert names("ann", "strict") == ["R1", "R2", "R3", "R4"]
    assert names("bob", "strict") == ["R2", "R3", "R4"]
    assert names("eve", "reference") == ["R3"]


def test_public_report_opens_all_in_reference_mode(who):
    allowed = lambda report, mode: access.has_permission(*who, "eve", report, mode).first().allowed
    assert allowed("R1", "reference") and not allowed("R1", "strict") and allowed("R3", "strict")


def test_access_matrix(who):
    assert rows(access.report_access(*who), "report", "kind", "audience", "n_users") == [("R1", "group", "DEV", 1), ("R3", "public", "*", 3)]
    strict = rows(access.report_access(*who, "strict"), "report", "kind", "audience", "n_users")
    assert strict == [("R1", "group", "DEV", 1), ("R2", "group", "DEV", 1), ("R2", "group", "OPS", 2), ("R3", "public", "*", 3),
                      ("R4", "user", "ANN", 1), ("R4", "user", "BOB", 1)]


# ---------------------------------------------------------------- trees and builds


def test_walks(spark):
    t = spark.createDataFrame([(1, 0, "root", "directory"), (2, 1, "a", "directory"), (3, 2, "b.txt", "text/plain"), (4, 1, "c.txt", "text/plain")],
                              "id long, parent_id long, name string, mime string")
    assert rows(tree.descendants(t, 1), "id", "depth", "path") == [(1, 0, "root"), (2, 1, "root/a"), (3, 2, "root/a/b.txt"), (4, 1, "root/c.txt")]
    assert rows(tree.ancestors(t, 3), "ancestor_id", "depth") == [(1, 2), (2, 1)]
    assert rows(tree.search_tree(t, 1, "TXT"), "id", "path") == [(3, "root/a/b.txt"), (4, "root/c.txt")]
    assert rows(tree.children_with_flag(t, 0), "id", "dirs") == [(1, 1)]


def test_job_cycles_end(spark):
    jobs = spark.createDataFrame([("a", "b, c"), ("b", "d"), ("d", "a"), ("x", None)], "job string, children string")
    assert rows(tree.job_closure(tree.child_edges(jobs), "a")) == [("b", 1), ("c", 1), ("d", 2)]


def test_cycle_in_a_tree_ends(spark):
    t = spark.createDataFrame([(1, 2, "a", "d"), (2, 1, "b", "d"), (3, 3, "c", "d")], "id long, parent_id long, name string, mime string")
    assert rows(tree.descendants(t, 1), "id", "depth") == [(1, 0), (2, 1)]
    assert rows(tree.ancestors(t, 1), "ancestor_id", "depth") == [(1, 2), (2, 1)]


def test_deep_chain_has_no_level_limit(spark, monkeypatch):
    monkeypatch.setattr(tree, "COMPACT", 4)
    t = spark.createDataFrame([(i, i - 1, str(i), "d") for i in range(1, 14)], "id long, parent_id long, name string, mime string")
    assert rows(tree.descendants(t, 1), "id", "depth") == sorted(((i, i - 1) for i in range(1, 14)), key=repr)


def test_range_positions(spark):
    b = spark.createDataFrame([("j", n, 0, 0, "SUCCESS") for n in (1, 2, 5, 9, 10, 11, 25)], "job string, number long, timestamp long, duration long, result string")
    assert rows(builds.build_range(b, "j", 1, 4, block=10), "position", "number") == [(1, 11), (2, 10), (3, 9)]
    assert [r.number for r in builds.latest_build(b).collect()] == [25]
    assert builds.last_build_by_result(b, "last_failed").isEmpty()
