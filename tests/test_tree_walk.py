"""What a walk over a tree sends to the driver."""

from conftest import plan
from runlens.operators import tree


def test_edges_of_a_small_file_are_not_broadcast_at_every_level(spark, tmp_path, monkeypatch):
    spark.range(1, 2001).selectExpr("id", "floor(id / 4) AS parent_id", "'n' AS name", "'directory' AS mime").write.parquet(str(tmp_path / "t"))
    df, steps, cut = spark.read.parquet(str(tmp_path / "t")), [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda level: (steps.append(plan(level)), cut(level))[1])
    found = tree.descendants(df, 1)
    assert found.count() == 1318  # ids 1, 4-7, 16-31, 64-127, 256-511 and 1024-2000
    inner = [step for step in steps if "BroadcastHashJoin Inner" in step or "SortMergeJoin Inner" in step]
    assert len(inner) == 6 and not any("BroadcastHashJoin Inner" in step for step in inner)
