"""Classes of alike rows from band keys: who shares a bucket is checked, links become components.

In a bucket each row meets the smallest and the largest one first. Buckets that still hold several
components then go through all their cross pairs, block by block inside numpy, those that agree most
first; one link between two components ends the search there. No bucket is capped, and pairs within a
group of copies are never written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, trim, trimmed
from .components import components

BLOCK = 1000  # members of a bucket that are compared with another block at a time

#: (signatures, i, places): how far row i agrees with the rows at the places, and the least worth a check.
Agreement = Callable[[list[bytes], int, np.ndarray], np.ndarray]
#: (one, other): whether two rows are alike, by what is kept of them.
Alike = Callable[[bytes, bytes], bool]


def checked(pairs: DataFrame, kept: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (a, b) that are alike by ``kept`` (row, ..., content). Both joins meet one row each with
    stored pairs, so Spark can split the pairs of a row that meets very many others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([alike(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    one = kept.select(F.col("row").alias("a"), F.col("content").alias("x"))
    two = kept.select(F.col("row").alias("b"), F.col("content").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def _apart_groups(members: DataFrame, block_size: int) -> DataFrame:
    """Rows of mixed buckets in groups of bounded size. ``members``: (key, row, label, main, size, rest); rows of the
    main component don't meet each other. A bucket is dealt into blocks; the ``rest`` rows outside the main
    component visit every block, in parts of bounded size, and a block is there once for each part."""
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / block_size).cast("int")).withColumn("parts", F.ceil(F.col("rest") / block_size).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    at_home = dealt.select("key", "row", "label", "main", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("home"))
    visits = dealt.where("not main").select("key", "row", "label", "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(False).alias("home"))
    return at_home.unionByName(visits)


def _cross_links(members: DataFrame, kept: DataFrame, agreement: Agreement, alike: Alike | None, block_size: int) -> DataFrame:
    """Links (a, b) between different components in a bucket (see ``_apart_groups``): one for each row and other
    component that has an alike row. Without ``alike`` the row that agrees best with it, unchecked."""
    content = ["content"] if alike else []
    signed = _apart_groups(members, block_size).join(kept.select("row", "signature", *content), "row")

    def run(t: pa.Table) -> pa.Table:
        rows, labels = np.array(t["row"]), np.array(t["label"])
        signatures = t["signature"].to_pylist()
        contents = t["content"].to_pylist() if alike else None
        out: list[tuple[int, int]] = []
        for i, at in _meetings(t):
            agree = agreement(signatures, i, at)
            at = at[np.argsort(-agree, kind="stable")][: int((agree >= 0).sum())]
            linked: set[int] = set()
            for j in at.tolist():
                if labels[j] not in linked and (alike is None or alike(contents[i], contents[j])):
                    linked.add(labels[j])
                    out.append((max(rows[i], rows[j]), min(rows[i], rows[j])))
        trim()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return signed.groupBy("key", "block", "part").applyInArrow(run, "a long, b long")


def _hopeful(members: DataFrame, kept: DataFrame, agreement: Agreement, block_size: int) -> DataFrame:
    """(key, row) of the rows that some row of another component may agree with (see ``_cross_links``)."""
    signed = _apart_groups(members, block_size).join(kept.select("row", "signature"), "row")

    def run(t: pa.Table) -> pa.Table:
        signatures, keep = t["signature"].to_pylist(), np.zeros(t.num_rows, bool)
        for i, at in _meetings(t):
            near = at[agreement(signatures, i, at) >= 0]
            keep[near] = True
            keep[i] |= len(near) > 0
        trim()
        return t.select(["key", "row"]).filter(pa.array(keep))

    return signed.groupBy("key", "block", "part").applyInArrow(run, "key long, row long").distinct()


def _meetings(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each visitor of a group and the places of the rows it is compared with; two rest rows meet in the block of the
    smaller one."""
    rows, labels, main, home = (np.array(t[c]) for c in ("row", "label", "main", "home"))
    for i in np.flatnonzero(~home).tolist():
        yield i, np.flatnonzero(home & (labels != labels[i]) & (main | (rows < rows[i])))


def _mixed(inside: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, row, size) of buckets that hold several components, with label, main and rest; buckets of the
    same rows are met once."""
    named = inside.join(labels, F.col("row") == F.col("node"), "left").select("key", "row", "size", F.coalesce("label", "row").alias("label"))
    named = saved(named, "large-buckets")
    shares = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", "label")).alias("rows"))
    buckets = shares.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.col("n")).alias("chief"), F.max("n").alias("n"), F.bit_xor("rows").alias("rows"))
    once = buckets.where("labels > 1").groupBy("rows", "labels", "chief", "n").agg(F.min("key").alias("key"))
    chiefs = saved(once.select("key", "chief", "n"), "chief-components")
    return named.join(chiefs, "key").select("key", "row", "label", "size", (F.col("label") == F.col("chief")).alias("main"), (F.col("size") - F.col("n")).alias("rest"))


def _plausible(pairs: DataFrame, kept: DataFrame, agreement: Agreement) -> DataFrame:
    """The pairs (a, b) whose signatures don't exclude a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [agreement([x, y], 0, np.array([1]))[0] >= 0 for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = kept.select(F.col("row").alias("a"), F.col("signature").alias("x"))
    two = kept.select(F.col("row").alias("b"), F.col("signature").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked_labels(keys: DataFrame, kept: DataFrame, agreement: Agreement, alike: Alike, block_size: int = BLOCK, known: DataFrame | None = None, screen: bool = False) -> DataFrame:
    """(node, label) of every row that is linked to another one; the label is the smallest linked row.

    ``keys``: (key, row); ``kept``: (row, signature, content), one row each; ``known``: links (a, b), a > b, that
    need no check. ``agreement`` is negative for pairs that need no check. With ``screen`` signatures, much smaller than
    contents, go first, and the pairs of a mixed bucket that agree best are checked before all others. All steps
    are stored tables."""
    keys = saved(keys, "band-keys")
    ends = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("row").alias("low"), F.max("row").alias("high")).where("size > 1")
    buckets = saved(keys.join(saved(ends, "band-ends"), "key"), "buckets")
    met = F.explode(F.array_distinct(F.array("low", "high"))).alias("other")
    pairs = buckets.select("row", met).where("row <> other").select(F.greatest("row", "other").alias("a"), F.least("row", "other").alias("b"))
    pairs = pairs.distinct() if known is None else pairs.distinct().join(known, ["a", "b"], "left_anti")
    pairs = saved(pairs, "star-pairs")
    links = saved(checked(saved(_plausible(pairs, kept, agreement), "plausible-pairs") if screen else pairs, kept, alike), "star-links")
    if known is not None:
        links = links.unionByName(known)

    # buckets of up to three rows have met in full; larger ones meet where a row is still apart from the smallest
    labels = saved(components(links), "labels")
    label_of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    apart = pairs.join(links, ["a", "b"], "left_anti").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    apart = saved(apart.where("coalesce(a_label, a) <> coalesce(b_label, b)").select("a", "b"), "apart")
    if apart.isEmpty():
        return labels
    large = buckets.where("size > 3")
    starred = large.where("row <> low").select("key", F.col("row").alias("a"), F.col("low").alias("b"))
    keys_apart = saved(starred.join(apart, ["a", "b"], "left_semi").select("key").distinct(), "mixed-buckets")
    crossing = _mixed(large.join(keys_apart, "key", "left_semi").select("key", "row", "size"), labels)
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    if screen:
        best = saved(_cross_links(crossing, kept, agreement, None, block_size).distinct(), "best-pairs")
        stars = stars.unionByName(saved(checked(best, kept, alike), "best-links"))
        labels = saved(components(stars), "labels")
        stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        crossing = _mixed(crossing.select("key", "row", "size"), labels)
        # of what is left, contents move for rows that may still agree with some other component
        crossing = crossing.join(saved(_hopeful(crossing, kept, agreement, block_size), "hopeful-rows"), ["key", "row"], "left_semi")
    more = saved(_cross_links(crossing, kept, agreement, alike, block_size).distinct(), "cross-links")
    if more.isEmpty():
        return labels
    return saved(components(stars.unionByName(more)), "labels")


def named_classes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (row, doc_id, first, ...) with label, class_id (the smallest doc_id, null if all are)
    and class_size; ``first`` is the row that stands for its equals."""
    others = [c for c in members.columns if c != "first"]
    named = members.join(labels, F.col("first") == F.col("node"), "left").select(*others, F.coalesce("label", "first").alias("label"))
    named = saved(named, "named")
    classes = saved(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return named.join(classes, "label").select(*others, "label", "class_id", "class_size")
