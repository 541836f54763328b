"""URL rules by a sort-merge range join: reversed hosts make prefixes intervals, a sweep keeps a stack.

The canonical key of a host and path is the host's labels in reverse, each followed by a comma, then a
blank, then the path: ``org,example, /es/``. A rule covers the keys that begin with its own key, an
interval of the sorted keys, and intervals either nest or are apart. As a rule also covers subdomains
whatever stands between its host and the path, a URL asks once for each number of its last labels
that some rule has (bounded by the rules, not by the URLs).

Keys and rules are cut into the same sorted ranges. A range gets the rules that begin in it, and as
its opening stack the rules whose interval holds its first key: at most one for each character of
that key. One pass over a sorted range then keeps the active nested rules on a stack; the top one is
the longest for its number of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up
    to ``?``, ``#`` or the end. A null URL or one without ``://`` has neither (empty)."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, depth: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.slice(labels, F.lit(1), depth), ","), F.lit(", "), path)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(key, depth, rule, verdict, size) of rules (host, path, verdict); hosts in lower case. Null parts
    are empty; rules with an empty host cover nothing. Of equal rules with different verdicts, block holds."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    labels = reversed_labels(host)
    rows = rules.select(host.alias("h"), path.alias("p"), labels.alias("l"), "verdict").where("h <> ''")
    keyed = rows.select(
        _key(F.col("l"), F.size("l"), F.col("p")).alias("key"), F.size("l").alias("depth"),
        F.concat("h", "p").alias("rule"), F.col("verdict"), F.length(F.concat("h", "p")).alias("size"),
    )
    return keyed.groupBy("key", "depth", "rule", "size").agg(F.max("verdict").alias("verdict"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ranges: rules (kind 0) before the keys (kind 1) they cover."""
    schema = pa.schema([("row", pa.int64()), ("size", pa.int32()), ("depth", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])
    now, stack = None, []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["bucket"] != now:
                now, stack = row["bucket"], []
            while stack and not row["key"].startswith(stack[-1]["key"]):
                stack.pop()
            if row["kind"] == 0:
                stack.append(row)
            elif stack:
                # keys of another number of labels lie apart: a comma is never followed by a blank there
                top = stack[-1]
                out.append((row["row"], top["size"], top["depth"], top["rule"], top["verdict"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule, verdict of every row of ``pages`` (``key``, url).

    The longest covering rule wins (host and path together; then the one with the longer host). Without
    one the rule is null and the verdict ``default``. Repeated rows are judged each; ties have no order.
    Both inputs may be large: nothing but the first keys of the ranges and the numbers of labels among
    the rules reaches the driver."""
    spark = pages.sparkSession
    prepare(spark)
    rules = saved(canonical_rules(rules), "url-rules")
    depths = [r["depth"] for r in rules.select("depth").distinct().collect()]  # numbers of labels: a few
    host, path = host_and_path(F.col("url"))
    urls = saved(pages.select(F.monotonically_increasing_id().alias("row"), F.col(key), host.alias("host"), path.alias("path")), "urls")
    if not depths:
        return urls.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = reversed_labels(F.col("host"))
    asked = urls.where("host <> ''").withColumn("l", labels).withColumn(
        "depth", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size("l")))
    )
    keys = asked.select(_key(F.col("l"), F.col("depth"), F.col("path")).alias("key"), "row")

    # ranges of keys by a fixed-size sample of them; (key, row) tells the rows of one frequent key apart
    parts = shuffle_partitions(spark)
    spread = keys.select("key", F.xxhash64("row").alias("salt"))
    sample = spread.orderBy(F.xxhash64("key", "salt")).limit(20 * parts).orderBy("key", "salt").collect()
    step = max(1, len(sample) // parts)
    bounds = [(r["key"], r["salt"]) for r in sample[step::step]][: parts - 1]

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            at = [bisect_right(bounds, k) for k in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist())]
            cols = [pa.array(at, pa.int32()), batch.column("key"), batch.column("salt"), batch.column("row")]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "key", "salt", "row"])

    probes = keys.withColumn("salt", F.xxhash64("row")).select("key", "salt", "row").mapInArrow(ranged, "bucket int, key string, salt long, row long")
    least = -(2**63)
    starts = rules.select("key", F.lit(least).alias("salt"), F.lit(0).cast("long").alias("row")).mapInArrow(ranged, "bucket int, key string, salt long, row long")
    begun = starts.select("bucket", "key").join(rules, "key")
    # the opening stacks: rules whose key begins the first key of a range
    opening = spark.createDataFrame([(i + 1, b[0][:n]) for i, b in enumerate(bounds) for n in range(1, len(b[0]) + 1)] or [(0, "")], "bucket int, key string")
    opened = opening.join(rules, "key")
    active = begun.unionByName(opened).dropDuplicates(["bucket", "key", "rule"])
    nothing = F.lit(None)
    events = active.select("bucket", "key", F.lit(0).alias("kind"), F.lit(least).alias("salt"), F.lit(0).cast("long").alias("row"), "size", "depth", "rule", "verdict").unionByName(
        probes.select("bucket", "key", F.lit(1).alias("kind"), "salt", "row", *[nothing.cast(t).alias(c) for c, t in (("size", "int"), ("depth", "int"), ("rule", "string"), ("verdict", "string"))])
    )
    swept = events.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "key", "kind", "salt", "row")
    found = swept.mapInArrow(_sweep, "row long, size int, depth int, rule string, verdict string")
    # one row for each number of labels that has a rule: the longest of these few is the URL's
    best = found.groupBy("row").agg(F.max(F.struct("size", "depth", "rule", "verdict")).alias("best"))
    joined = urls.join(best, "row", "left")
    return joined.select(key, "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
