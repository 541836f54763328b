"""Periodic runs against a search of every period and start."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from conftest import DATA
from runlens.llm import queries
from runlens.llm.periodic import extend, periodic_runs, runs_of, scales, seeds


def by_force(words, shortest=6, repeats=4):
    """Runs of a sequence: every period, every maximal stretch, kept if no smaller period holds in it."""
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(shortest, repeats * q) and not any(all(x == y for x, y in zip(part, part[p:])) for p in range(1, q)):
                found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The row of the query, from its definition."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_force(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_scales_cover_every_period_with_a_length_that_decides():
    periods = []
    for lo, hi, k in scales(50_000):
        periods += range(lo, hi + 1)
        assert 2 * hi - 1 <= k <= max(4 * lo, 6) - lo
    assert periods == list(range(1, len(periods) + 1)) and periods[-1] >= 50_000 // 4


def test_runs_of_random_texts_equal_every_run_by_force():
    rng, total = random.Random(7), 0
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = []
            while len(words) < rng.randint(0, 90):
                words += [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
                words *= rng.choice([1, 1, 1, 4])
            texts.append(words[:400])
        flat = np.array([w for words in texts for w in words], np.uint64)
        got = runs_of(flat, np.append(0, np.cumsum([len(w) for w in texts])).astype(np.int64))
        for i, words in enumerate(texts):
            assert got.get(i, []) == by_force(words)
            total += len(got.get(i, []))
    assert total > 1000


def test_covered_seeds_are_not_extended_again(monkeypatch):
    from runlens.llm import periodic

    words = np.array([1, 2, 3] * 5000, np.uint64)
    found = seeds(words, np.array([0, len(words)]))
    calls = []
    count = periodic._matches
    monkeypatch.setattr(periodic, "_matches", lambda a, b: calls.append(1) or count(a, b))
    assert len(found) > 10_000 and set(found[:, 1].tolist()) == {3}
    assert extend(words, found[:, 1:]) == [(0, 15_000, 3)] and len(calls) == 2


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, DATA).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == {expected(d.doc_id, d.text) for d in docs} and any(r[1] for r in got)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\x0b\n"), (None, "a " * 40), (4, "É é " * 3 + "\x00  "), (4, "É é " * 3 + "\x00  "), (5, ("x y z " * 30_000) + "end"), (93, "one two three four five six seven eight nine")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([expected(*r) for r in rows[:6]] + [tuple(r) for r in got if r.doc_id in (5, 93)], key=repr)
    long = next(r for r in got if r.doc_id == 5)
    if zlib.crc32(b"5") % 10:
        assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 90_000, 3)
    frame = spark.createDataFrame([(1, "w w w w w w", "kept")], "doc_id long, text string, start string")
    row = periodic_runs(frame).first()
    assert (row.start, row.collapsed, [tuple(r) for r in row.runs]) == ("kept", "w", [(0, 6, 1)])
    assert periodic_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="collapsed"):
        periodic_runs(frame.withColumnRenamed("start", "collapsed"))
