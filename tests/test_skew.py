"""Joins with one key that holds a third of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.operators import changes, joins, validation
from runlens.operators.skew import join_on_unique


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))
    )
    return spark.range(30_000).select("id", key.alias("k"))


@pytest.fixture(scope="module")
def unique(skewed):
    return skewed.where("k <> 'k17'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_result_as_a_plain_join(skewed, unique, how):
    got = join_on_unique(skewed, unique, ["k"], how)
    assert rows(got) == rows(skewed.join(unique, "k", how).select(got.columns))


@pytest.fixture
def finely_split(spark):
    """Every partition is large enough to be split, and nothing is small enough to be broadcast."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "200",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split_though_the_other_side_was_aggregated_by_it(finely_split, skewed, unique):
    big = skewed.repartition(8)
    assert "skew=true" in executed(join_on_unique(big, unique, ["k"]))
    assert "skew=true" not in executed(big.join(unique, "k", "left"))  # why the helper exists


def test_a_key_of_a_twentieth_is_split_too(finely_split):
    big = finely_split.range(100_000).select("id", F.when(F.col("id") % 20 == 0, -1).otherwise(F.col("id")).alias("k")).repartition(8)
    unique = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_on_unique(big, unique, ["k"], "inner")
    assert "skew=true" in executed(got)
    assert got.where("k = -1").agg(F.min("n"), F.count(F.lit(1))).first() == (5000, 5000)


def test_nothing_runs_when_the_plan_is_made(spark, skewed, unique):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    join_on_unique(skewed, unique, ["k"])
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_text_keys_without_regard_to_case(spark):
    big = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, "c"), (4, None)], "id int, k string")
    unique = spark.createDataFrame([("AB", 7), (None, 8)], "k string, n int")
    assert rows(join_on_unique(big, unique, ["k"]), "id", "n") == [(1, 7), (2, 7), (3, None), (4, None)]
    assert rows(join_on_unique(big, unique, ["k"], "inner", fold=False)) == []


def test_empty_sides(skewed, unique):
    assert join_on_unique(skewed.where("id < 0"), unique, ["k"], "left").count() == 0
    assert join_on_unique(skewed, unique.where("n < 0"), ["k"], "left").count() == 30_000


def test_errors_of_a_hot_instance(spark):
    runs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("instance_id"))
    errs = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("tmf_id"))
    got = joins.errors_for_instance(errs, runs)
    per = Counter(r.instance_id for r in runs.collect())
    assert rows(got, "id", "copies") == sorted(((e.id, per[e.tmf_id]) for e in errs.collect() if per[e.tmf_id]), key=repr)


def test_update_on_a_hot_key(skewed):
    new = skewed.select("k").distinct().where("k is not null").select("k", F.lit(5).alias("v"))
    table = skewed.withColumn("v", F.lit(1))
    got = changes.update_by_key(table, new, ["k"])
    assert got.count() == 30_000
    assert got.where("v = 5").count() == skewed.where("k is not null").count()


def test_unique_rule_on_a_hot_value(skewed):
    checked = validation.check_rows(skewed, {"k": [("is_unique",)]}, "id")
    n_values = skewed.where("k is not null").select("k").distinct().count()
    assert validation.violations(checked, "id").count() == skewed.where("k is not null").count() - n_values
