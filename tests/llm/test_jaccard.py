"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import jaccard
from runlens.llm.jaccard import EPS, RADIUS, Pivots, agreement, far_keys, jaccard_components, linked, most_apart, pack, sketch, thinned, unpack

DOCS = "doc_id long, text string, row string, key string, label string, k1 string"


def words_of(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def set_of(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def by_force(docs):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [set_of(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted([(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)], key=repr)


def edited(words, rng, share):
    """Words with about that share of single changes."""
    words = list(words)
    for _ in range(max(1, int(len(words) * share))):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[i] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"new{rng.randrange(10**6)}")
    return words


def corpus(seed, bases=25, copies=8):
    """Texts of all sizes with chains of edits, a passage that many share, and copies."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for _ in range(bases):
        n = rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 33, 60, 64, 100, 127, 130, 300, 700])
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        if rng.random() < 0.4:
            words[rng.randrange(n) :] += passage
        texts.append(words)
        for _ in range(rng.randrange(copies)):
            words = edited(words if rng.random() < 0.6 else texts[-1], rng, rng.choice([0.0, 0.005, 0.02, 0.03, 0.04, 0.05]))
            texts.append(words)
    texts += [texts[0], [w.upper() for w in texts[0]], passage, passage[:-1], edited(passage, rng, 0.01)]
    docs = [(rng.randrange(10**6), " ".join(t)) for t in texts]
    rng.shuffle(docs)
    return docs


def as_arrays(docs):
    elements, offsets = jaccard.shingle_sets(__import__("pyarrow").array([t for _, t in docs]))
    return [elements[s:e] for s, e in zip(offsets, offsets[1:])], elements, offsets


def pairs_of(sets):
    for i in range(len(sets)):
        for j in range(i):
            yield i, j, len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_region(seed):
    """Beside a few pivots, and with common shingles last: no linked pair is lost, whatever the classes."""
    sets, elements, offsets = as_arrays(corpus(seed))
    counted = np.unique(elements, return_counts=True)
    common = counted[0][counted[1] >= 4] if seed % 2 else np.zeros(0, np.uint64)
    keys, rows = far_keys(elements, offsets, common)
    regions = [set() for _ in sets]
    for k, r in zip(keys.tolist(), rows.tolist()):
        regions[r].add(k)
    chosen = [0, 5, 9]
    row, pivot, distance, nearest = Pivots([sets[c] for c in chosen]).regions(elements, offsets)
    near = [set() for _ in sets]
    for r, p in zip(row.tolist(), pivot.tolist()):
        near[r].add(p)
    links = 0
    for i, j, both, a, b in pairs_of(sets):
        if linked(a, b, both):
            links += 1
            assert a + b - 2 * both <= most_apart(np.array([a]), np.array([b]))[0]
            assert regions[i] & regions[j], (a, b, both)
            if min(nearest[i], nearest[j]) <= RADIUS:
                assert near[i] & near[j]
            assert agreement([sketch(sets[i]), sketch(sets[j])], 0, np.array([1]))[0] >= 0
    assert links > 20
    large = [np.unique(np.random.default_rng(k).integers(0, 1 << 48, 900 + 300 * k, dtype=np.uint64)) for k in range(3)]
    assert (agreement([sketch(x) for x in large], 0, np.array([1, 2])) < 0).all()  # unrelated ones are excluded
    assert max(len(r) for r in regions) <= 0.5 * max(map(len, sets)) + 4


def test_distances_to_pivots_and_thinning():
    sets, elements, offsets = as_arrays(corpus(11, 12))
    row, pivot, distance = Pivots(sets).near(elements, offsets)
    got = {(r, p): d for r, p, d in zip(row.tolist(), pivot.tolist(), distance.tolist())}
    want = {(i, j): 1 - both / (a + b - both) for i, j, both, a, b in pairs_of(sets) if both}
    assert {k: v for k, v in got.items() if k[0] > k[1]} == pytest.approx(want)
    chosen = thinned(sets)
    assert all(got.get((i, j), 1) > RADIUS for i in chosen for j in chosen if i != j)
    assert all(any(got.get((i, j), 1) <= RADIUS for j in chosen) for i in range(len(sets)) if len(sets[i]))


def test_packed_sets_come_back():
    x = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000, dtype=np.uint64))
    assert (unpack(pack(x)) == x).all() and len(unpack(b"")) == 0


@pytest.mark.parametrize("sample", [0, 6, 1024])
def test_components_equal_all_pairs(spark, monkeypatch, sample):
    """With every set far from the pivots, with few pivots and with the usual sample."""
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    docs = corpus(21, 30)
    frame = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], DOCS).repartition(5)
    got = sorted([tuple(r) for r in jaccard_components(frame).collect()], key=repr)
    assert got == by_force(docs) and len({r[2] for r in got}) < len(docs) - 30


def test_a_large_group_of_near_copies_and_a_hot_passage(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(i, " ".join(edited(base, rng, 0.01))) for i in range(300)]
    docs += [(1000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(30))) for i in range(300)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c in by_force(docs)}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (5, "A  B"), (None, "a b"), (None, "lone words"), (6, "É x"), (7, "é x"), (8, "one\x00two \x1cthree"), (9, "w " * 200_000), (10, "w " * 7)]
    frame = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], DOCS)
    assert sorted([tuple(r) for r in jaccard_components(frame).collect()], key=repr) == by_force(docs)
    assert jaccard_components(frame.limit(0)).collect() == []
    assert jaccard_components(frame.where(F.col("doc_id") <= 3)).count() == 3
    assert EPS == pytest.approx(0.2)
