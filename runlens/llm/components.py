"""Connected components of links between rows, by alternating large and small stars.

Each round links every neighbour of a node to the smallest node near it; the links become stars round
the smallest node of each component in a few rounds (logarithmic in practice). A round's minima and
links are stored tables, so Spark can split the links of a hub between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link at most, to a node that has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("hub")).unionAll(
        links.select(F.col("b"), F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("hub").alias("hub"))
    return nodes.where("up > 1 or (up = 1 and hub = 1)").isEmpty()


def _small_stars(links: DataFrame) -> DataFrame:
    """Each node (a) and its smaller neighbours (b), linked to the smallest of them."""
    least = saved(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long): the label is the smallest node of its
    component. Null ends and links of a node to itself are passed over; repeated links are one."""
    real = links.where("a is not null and b is not null and a <> b")
    # the small star comes first: many links to a few leaders become one link a node
    now = _small_stars(saved(real.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"))
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        upward = now.select(F.col("b").alias("a"), F.col("a").alias("b"))  # from the smaller end
        large = upward.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = _small_stars(saved(large, "large-stars"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
