"""Deep pages, pointer doubling, interval labels, trigram postings, the day roll-up, text without regard to case."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from runlens.operators import access, aggregates, context, joins, paging, postings, tree, validation
from runlens.plans import rollup, trends

TREE = "id long, parent_id long, name string, mime string"


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize("order", [[("a", "asc"), ("b", "desc")], [("a", "desc"), ("b", "asc")], [("c", "desc"), ("t", "asc"), ("b", "asc")], [("n", "asc"), ("b", "asc")]])
def test_deep_pages_equal_the_sorted_list(spark, monkeypatch, order):
    monkeypatch.setattr(paging, "DEEP", 40)
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.choice([None, 1.5, float("nan"), rng.random()]), i, rng.choice(["x", "X", None]), start + dt.timedelta(minutes=rng.randrange(99)), None) for i in range(900)]
    df = spark.createDataFrame(data, "a double, b int, c string, t timestamp_ntz, n string")
    want = [r.b for r in paging.sort(df, order).collect()]
    for offset in (0, 30, 41, 333, 870, 895, 2000):
        assert [r.b for r in paging.page(df, order, 20, offset).collect()] == want[offset : offset + 20]
        got = paging.page_with_total(df, order, 20, offset).collect()
        assert [r.b for r in got] == want[offset : offset + 20] and {r.total for r in got} <= {900}


def test_a_deep_page_sorts_one_range_that_reaches_the_scan(spark, tmp_path):
    spark.range(200_000).withColumn("x", F.hash("id")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    inside, rest, total = paging.narrowed(df, [("id", "asc")], 10, 100_000)
    assert total == 200_000 and inside.count() <= paging.DEEP and rest < paging.DEEP
    assert [r.id for r in inside.orderBy("id").offset(rest).limit(10).collect()] == list(range(100_000, 100_010))
    assert "GreaterThan(id" in plan(inside) and "LessThan(id" in plan(inside)


# ---------------------------------------------------------------- trees


def counted(monkeypatch):
    """How often a lineage is cut."""
    calls, cut = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: calls.append(1) or cut(df))
    return calls


def test_a_chain_of_a_thousand_levels_in_about_ten_rounds(spark, monkeypatch):
    chain = spark.range(1, 1001).select("id", (F.col("id") - 1).alias("parent_id"), F.lit("n").alias("name"), F.lit("directory").alias("mime"))
    calls = counted(monkeypatch)
    got = rows(tree.ancestors(chain, 1000))
    assert sorted(r[1:] for r in got) == sorted((1000 - d, d) for d in range(1, 1000))
    assert len(calls) <= 3 * 12
    calls.clear()
    labels = tree.label_tree(chain)
    assert labels.agg(F.max("depth")).first()[0] == 999 and len(calls) <= 14
    assert tree.labelled_descendants(labels, 400).count() == 601


def by_walk(edges, i):
    """Ancestors of a row by following its parents, each once."""
    found, at, depth = {}, i, 0
    while at in edges and edges[at] in edges and edges[at] not in found:
        if depth and edges[at] == at:
            break
        at, depth = edges[at], depth + 1
        found[at] = depth
    return found


def test_doubling_equals_the_walk_and_cycles_end(spark):
    edges = {1: 0, 2: 1, 3: 2, 4: 2, 5: 5, 6: 5, 7: 8, 8: 9, 9: 7, 10: 9, 11: 77, 12: 11, 13: 10}
    df = spark.createDataFrame([(i, p, f"n{i}", "directory") for i, p in edges.items()], TREE)
    got = rows(tree.ancestors(df, df.select("id")))
    assert got == sorted((i, a, d) for i in edges for a, d in by_walk(edges, i).items())
    labels = tree.label_tree(df)
    assert sorted(r.id for r in labels.collect()) == [1, 2, 3, 4, 5, 6, 11, 12]
    for root in (1, 2, 5, 11):
        assert rows(tree.labelled_descendants(labels, root), "id", "depth", "path") == rows(tree.descendants(df, root), "id", "depth", "path")
    assert tree.labelled_descendants(labels, 7).count() == 0


def test_labels_of_random_trees(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, rng.randrange(max(i - 30, 0), i), f"n{i % 7}", rng.choice(["directory", "directory", "text/plain"])) for i in range(1, 300)]
    df = spark.createDataFrame([(-5, 999, "other", "directory"), (0, 0, "root", "directory"), *data], TREE)
    tree.store_labels(tree.label_tree(df), f"{tmp_path}/labels")
    labels = spark.read.parquet(f"{tmp_path}/labels")
    for root in (0, 3, 40, -5):
        assert rows(tree.labelled_descendants(labels, root)) == rows(tree.descendants(df, root))
        assert rows(tree.labelled_descendants(labels, root, True)) == rows(tree.descendants(df, root, True))
        assert rows(tree.search_tree(df, root, "N3", labels=labels)) == rows(tree.search_tree(df, root, "N3"))
    text = plan(tree.labelled_descendants(labels, 3))
    assert "GreaterThanOrEqual(low" in text and "LessThan(low" in text and "Join" not in text


# ---------------------------------------------------------------- postings


@pytest.mark.parametrize("text", ["ring", "RiN", "é a", "in", "", "r%ng", "a_c", "100%", "ß", "zzz", "abcabc", "%"])
def test_postings_find_what_the_scan_finds(spark, tmp_path, text):
    words = ["Ring", "string", "É ab", "abc", "aXc", "100% done", "Straße", "abcabcab", "", None, "rang", "r ng"]
    df = spark.createDataFrame([(i, a, b, i % 3) for i, (a, b) in enumerate((a, b) for a in words for b in words)], "id int, a string, b string, p int")
    postings.store(df, "id", ["a", "b"], "p", f"{tmp_path}/x")
    found = postings.search(df, spark.read.parquet(f"{tmp_path}/x"), "id", ["a", "b"], text)
    from runlens.functions.text import or_like

    assert rows(found) == rows(df.where(or_like([F.col("a"), F.col("b")], text, escape=False)))


def test_a_changed_partition_is_replaced_alone(spark, tmp_path):
    df = spark.createDataFrame([(1, "first", 0), (2, "second", 1)], "id int, a string, p int")
    path = f"{tmp_path}/x"
    postings.store(df, "id", ["a"], "p", path)
    new = df.where("p = 1").withColumn("a", F.lit("third"))
    postings.store(new, "id", ["a"], "p", path)
    now = df.where("p = 0").unionByName(new)
    stored = spark.read.parquet(path)
    assert [r.id for r in postings.search(now, stored, "id", ["a"], "third").collect()] == [2]
    assert stored.where("gram = 'SEC'").isEmpty() and not stored.where("gram = 'FIR'").isEmpty()
    text = plan(stored.where(F.col("gram").isin("FIR", "IRS")))
    assert "In(gram" in text


# ---------------------------------------------------------------- day roll-up


def test_roll_up_follows_appends_and_status_changes(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2023, 6, 1)

    def run(i, status):
        moment = None if i % 50 == 0 else start + dt.timedelta(minutes=rng.randrange(0, 400_000))
        return (i, status, rng.choice(["STG_A", "dim_b", "stg_a", None]), rng.choice(["DW_X", "dw_x", None]), moment)

    schema = "id int, status string, job_name string, dimension string, last_activity timestamp_ntz"
    old = spark.createDataFrame([run(i, rng.choice(["ready", "running", "error", "Ready"])) for i in range(800)], schema)
    path, as_of = f"{tmp_path}/days", "2024-02-10 09:30:00"
    rollup.build(old, path)
    assert rows(rollup.dashboard(spark.read.parquet(path), old, as_of)) == rows(trends.dashboard(old, as_of))
    changed = old.where("id % 7 = 0")
    moved = changed.withColumn("status", F.lit("ready")).withColumn("last_activity", F.col("last_activity") + F.expr("INTERVAL 3 DAYS"))
    more = spark.createDataFrame([run(i, "error") for i in range(900, 950)], schema)
    now = old.where("id % 7 <> 0").unionByName(moved).unionByName(more)
    days = rollup.changed_days(changed, moved, more)
    for _ in range(2):
        rollup.refresh(now, path, days)
        assert rows(rollup.dashboard(spark.read.parquet(path), now, as_of)) == rows(trends.dashboard(now, as_of))


def test_a_day_without_runs_is_emptied(spark, tmp_path):
    df = spark.createDataFrame([(1, "ready", "a", "b", dt.datetime(2024, 1, 1)), (2, "ready", "a", "b", dt.datetime(2024, 1, 2))], "id int, status string, job_name string, dimension string, last_activity timestamp_ntz")
    path = f"{tmp_path}/days"
    rollup.build(df, path)
    left = df.where("id = 2")
    rollup.refresh(left, path, rollup.changed_days(df.where("id = 1")))
    assert rows(rollup.dashboard(spark.read.parquet(path), left, "2024-02-01 00:00:00")) == rows(trends.dashboard(left, "2024-02-01 00:00:00"))


# ---------------------------------------------------------------- text without regard to case


def test_groups_names_and_keys_without_regard_to_case(spark):
    df = spark.createDataFrame([("a", 1), ("A", 2), ("b", 3), (None, 4)], "k string, n int")
    assert rows(aggregates.group_by(df, ["k"], {"s": F.sum("n")})) == [("A", 3), ("b", 3), (None, 4)]
    assert rows(aggregates.having(df, ["k"], {"s": F.sum("n")}, F.col("s") > 3, exact=True)) == [(None, 4)]
    named = lambda *names: spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)], "Id int, ProjectName string, IsActive int")
    env = spark.createDataFrame([(0, "Dev", 1), (1, "DEV", 1)], "Id int, Environment string, IsActive int")
    ctx = spark.createDataFrame([(i, k, 1, i, i, "v", 0, "") for i, k in enumerate("kK")], "Id int, ContextKey string, IsActive int, ProjectDetailsFK int, EnvironmentFK int, ContextValue string, isEncrypted int, Description string")
    got = {r.kind: r.available for r in context.context_panel(ctx, env, named("p", "P", "q")).collect()}
    assert got == {"project": 2, "environment": 1, "context": 1}
    one = ctx.where("Id = 1")
    assert rows(context.context_matrix(one, env, named("p", "P"), ["dev"])) == [("K", "v")]
    users = spark.createDataFrame([("u", 1), ("U", 1), ("v", 1)], "name string, groupId int")
    groups = spark.createDataFrame([(1, "G")], "id int, name string")
    assert access.user_groups(users, groups).count() == 2
    reports = spark.createDataFrame([(1, "r", "g", "*")], "id int, name string, groups string, users string")
    assert {(r.kind, r.n_users) for r in access.report_access(reports, users, groups).collect()} == {("group", 2), ("public", 2)}


def test_files_with_several_entries_stay_one_row(spark):
    files = spark.createDataFrame([("Job", "x.csv"), ("other", "x.csv")], "job string, delivered string")
    registry = spark.createDataFrame([("JOB", 1, "x", ".csv"), ("job", 1, "y", ".csv")], "job string, file int, file_name string, component_type string")
    assert rows(joins.match_files(files, registry, ["job"]), "job", "accepted") == [("Job", True), ("other", False)]


def test_comparisons_take_what_counts_as_a_number(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1e5", "5.", " 7", "+.5E1", "5d", "NaN", "", "e5", "."])], "id int, v string")
    checked = validation.check_rows(df, {"v": ["required", ("greater_than", 3)]}, "id")
    assert {r.id for r in validation.violations(checked, "id").collect()} == {4, 5, 6, 7, 8}
