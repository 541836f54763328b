"""The Merkle manifest against trees built node by node."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import queries
from runlens.llm.merkle import STEP, address, build, build_manifest, count_at, digest_of, fold, proofs, siblings, verified

DOCS = "doc_id long, source string, lang string, n_chars long, text string, group string, rank long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def path(levels, i):
    """(side, sibling) of each step; side is None where there is no sibling."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((None, "") if other >= len(level) else ("left" if i & 1 else "right", level[other]))
        i >>= 1
    return out


def by_force(docs):
    """Rows of the query for (doc_id, source, lang, n_chars, text)."""
    order = lambda v: (v is not None, v)
    langs = {}
    for d in docs:
        langs.setdefault(d[2], []).append((order(d[0]), leaf_of(*d), d))
    names = sorted(langs, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {}
    for g in names:
        langs[g].sort(key=lambda x: x[:2])
        trees[g] = tree([leaf for _, leaf, _ in langs[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, leaf, d) in enumerate(langs[g]):
            steps = path(trees[g], i) + path(top, k)
            now = leaf
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0:
                now = leaf_of(*d[:3], None if d[3] is None else d[3] + 1, d[4])
            for side, other in steps:
                now = sha(other, now) if side == "left" else sha(now, other)
            out.append((d[0], leaf, trees[g][-1][0], top[-1][0], sha(*[o for s, o in steps if s]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(docs, height):
    made = build_manifest(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), digest_of("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), F.when(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, digest_of("doc_id", "source", "lang", F.col("n_chars") + 1, "text")).alias("claimed")), height)
    got = verified(proofs(made))
    return made, sorted([(r.key, *[bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof_digest", "folded")], r.verified) for r in got.collect()], key=repr)


def test_layout_is_the_recursive_split():
    def layout(levels, depth, index):
        """Nodes of a subtree, in order."""
        if levels == 1:
            return [(depth, index)]
        top = levels // 2
        out = layout(top, depth, index)
        for k in range(1 << top):
            out += layout(levels - top, depth + top, (index << top) + k)
        return out

    for levels in range(1, 9):
        for place, (depth, index) in enumerate(layout(levels, 0, 0)):
            assert address(levels, depth, np.array([index]))[0] == place


def test_block_of_any_number_of_leaves():
    rng = random.Random(3)
    for n in [*range(1, 40), 100]:
        leaves = [sha(str(rng.random())) for _ in range(n)]
        height = (n - 1).bit_length()
        nodes = build(np.array([list(bytes.fromhex(x)) for x in leaves], np.uint8), height)
        levels = tree(leaves)
        assert nodes[0].tobytes().hex() == levels[-1][0] and count_at(n, height, 0) == 1
        steps = siblings(nodes, n, height)
        for i in range(n):
            root, digest = fold(bytes.fromhex(leaves[i]), steps[i].tobytes())
            assert root.hex() == levels[-1][0] and digest.hex() == sha(*[o for s, o in path(levels, i) if s])
            assert steps[i].tobytes()[::STEP] == bytes([{None: 0, "right": 1, "left": 2}[s] for s, _ in path(levels, i)])


def test_levels_of_small_blocks_equal_the_whole_tree(spark):
    rng = random.Random(5)
    sizes = {"en": 150, "de": 64, "fr": 16, "es": 4, "it": 1, "pt": 5, None: 17, "": 2, "é": 3, "z": 256}
    docs = [(rng.randint(-9, 10**6), f"s{rng.randint(0, 3)}", lang, rng.choice([None, rng.randint(0, 99)]), rng.choice([None, "", "téxt " * rng.randint(0, 5)])) for lang, n in sizes.items() for _ in range(n)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).repartition(7)
    for height in (1, 2, 4):
        made, got = manifest_rows(frame, height)
        assert got == by_force(docs)
        assert len(made.levels) == {1: 9, 2: 5, 4: 3}[height]


def test_odd_rows(spark, tmp_path):
    docs = [(None, None, None, None, None), (None, "", "", 0, ""), (5, "s", "en", 1, "same"), (5, "s", "en", 1, "same"), (5, "s", "en", 2, "other"), (6, "s", "en", None, "x" * 3_000_000), (13, "-", "en", 7, "1:-")]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    query = queries.QUERIES["op11_merkle_manifest"]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r[n] for n in names) for r in query(spark, str(tmp_path)).collect()], key=repr) == by_force(docs)
    assert query(spark, f"{tmp_path}/empty").collect() == []
    one = spark.createDataFrame([(*docs[2], "", 0)], DOCS)
    made, got = manifest_rows(one, 10)
    assert got == by_force(docs[2:3]) and got[0][4] == sha() and made.root.hex() == got[0][1]


def test_what_has_been_changed_is_found(spark):
    rows = spark.range(100).select(F.lit("g").alias("group"), F.col("id").alias("key"), digest_of("id").alias("leaf"), F.when(F.col("id") == 41, digest_of(F.lit("9"))).alias("claimed"))
    got = verified(proofs(build_manifest(rows, 3)))
    assert [r.key for r in got.where("not verified").collect()] == [41] and got.count() == 100
