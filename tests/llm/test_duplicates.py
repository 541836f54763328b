"""Near duplicates, components and edit fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import rows
from runlens.llm import minhash
from runlens.llm.components import components
from runlens.llm.edit_fingerprints import code_points, edit_classes, edit_fingerprints, likeness, likenesses, walker
from runlens.llm.minhash import drop_near_duplicates, near_duplicate_classes, pack_elements, shingles, signatures, similarity, weighted
from runlens.llm.words import ngrams, word_hashes

SCHEMA = "doc_id long, text string, label string, row string"
WORDS = [f"w{i}" for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, changes):
    words = t.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "new" + str(rng.random())
    return " ".join(words)


def bag(t):
    words = (t or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def brute_classes(docs):
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in docs]
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            common = sum((a & b).values())
            if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (doc_id, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(doc_id)
    return sorted((d, min((x for x in ids[find(i)] if x is not None), default=None), len(ids[find(i)])) for i, (d, _) in enumerate(docs) if d is not None)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = []
    for _ in range(12):
        base = text(rng, rng.randint(40, 120))
        out += [base, base.upper(), edited(rng, base, 1), edited(rng, base, 3), edited(rng, base, 8)]
    out += [text(rng, n) for n in (1, 2, 4, 5, 6)] + ["w1 w2", "W1  w2", "", None, "  \n", "a " * 300, "a " * 310]
    large = text(rng, 100)
    out += [edited(rng, large, 2) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [1000, 7])
def test_classes_equal_brute_force(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in corpus], SCHEMA)
    got = near_duplicate_classes(df)
    assert sorted(tuple(r) for r in got.select("doc_id", "class_id", "class_size").collect()) == brute_classes(corpus)


def test_one_of_each_class_stays(spark, corpus):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in corpus] + [(0, corpus[0][1], "x", "y"), (0, "quite another text", "z", "y")], SCHEMA)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = sorted({c for _, c, _ in brute_classes(corpus)})
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*want, 0])


def test_no_rows_and_null_ids(spark):
    assert near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", "", ""), (4, "A b c d e f", "", ""), (None, "q", "", "")], SCHEMA)
    assert rows(near_duplicate_classes(df), "doc_id", "class_id", "class_size") == sorted([(None, 4, 2), (4, 4, 2), (None, None, 1)], key=repr)
    assert rows(drop_near_duplicates(df), "doc_id", "text") == sorted([(4, "A b c d e f"), (None, "q")], key=repr)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    base = text(rng, 300) + " " + "x y z u v " * 10
    texts = [base, edited(rng, base, 10), text(rng, 300)]
    grams, offsets, _ = shingles(pa.array(texts))
    parts = weighted(grams, offsets)
    signed = signatures(*parts, 3, 2000)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        a, b = bag(texts[i]), bag(texts[j])
        common = sum((a & b).values())
        exact = common / (sum(a.values()) + sum(b.values()) - common)
        packed = [pack_elements(parts[1][parts[0] == k], parts[2][parts[0] == k]) for k in (i, j)]
        assert similarity(*packed) == pytest.approx(exact, abs=1e-9)
        assert (signed[i] == signed[j]).mean() == pytest.approx(exact, abs=0.05)


def test_signatures_of_very_light_and_heavy_sets():
    light = signatures(np.array([0]), np.array([7], np.uint64), np.array([1]), 2, 160)
    assert (light[1] == 0).all() and len(set(light[0].tolist())) > 100
    n = 30_000
    heavy = signatures(np.zeros(n, int), np.arange(n).astype(np.uint64), np.ones(n, int), 1, 160)
    assert heavy.all()


def test_word_hashes_do_not_depend_on_place_or_batch(monkeypatch):
    from runlens.llm import words

    texts = pa.array(["Ab cd", None, "", " cd\n\tab  ", "x" * 50 + " ab"])
    hashes, offsets = word_hashes(texts)
    assert offsets.tolist() == [0, 2, 2, 2, 4, 6]
    assert hashes[0] == hashes[3] == hashes[5] and hashes[1] == hashes[2]
    monkeypatch.setattr(words, "CHUNK", 4)
    assert (word_hashes(texts)[0] == hashes).all()
    assert (word_hashes(texts.slice(3))[0] == hashes[2:]).all()
    grams, gram_offsets = ngrams(hashes, offsets, 2)
    assert gram_offsets.tolist() == [0, 1, 1, 1, 2, 3] and len(set(grams.tolist())) == 3


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    links += [(2000, 2001 + i) for i in range(50)]
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(label.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(4)
    docs = [(i * 3, text(rng, rng.randint(1, 400))) for i in range(40)] + [(1007, None), (1008, ""), (1009, "é😀" * 40), (2000, "a" * 5000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    got = {r.doc_id: r for r in edit_fingerprints(df).collect()}
    order = sorted(docs)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        codes = code_points(want)
        assert got[i].edited_fingerprint == walker().fingerprint([(codes, walker().walk(codes, 0))])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [got[i] for i, t in docs if t and len(t) > 300 and len(set(t)) > 5]
    assert all(r.near_edited > r.near_next for r in long)
    assert np.mean([r.near_edited for r in long]) == pytest.approx(0.5, abs=0.12)


def test_repeated_null_and_single_ids(spark):
    df = spark.createDataFrame([(5, "b b b b", "", ""), (5, "a a a a", "", ""), (None, "n n", "", "")], SCHEMA)
    found = {(r.doc_id, r.edited_sha256) for r in edit_fingerprints(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {(None, sha("n a")), (5, sha("a a b b")), (5, sha("b b n n"))}
    one = edit_fingerprints(spark.createDataFrame([(1, "same text", "", "")], SCHEMA)).first()
    assert one.near_next == 1.0
    assert edit_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_follows_edit_distance():
    rng, w = random.Random(6), walker()

    def print_of(t):
        codes = code_points(t)
        return w.fingerprint([(codes, w.walk(codes, 0))])

    # one walk falls into step soon or late, so only the mean over texts is steady
    likes = []
    for _ in range(30):
        base = text(rng, 400)
        versions = [base, *(changed(rng, base, n) for n in (1, 10, 100)), text(rng, 400)]
        own = print_of(base)
        likes.append([likeness(own, print_of(t)) for t in versions])
    mean = np.mean(likes, axis=0)
    assert mean[0] == 1.0 and (np.diff(mean) < 0).all() and mean[1] > 0.6 and mean[-1] < 0.25
    assert likeness(print_of(""), print_of("")) == 1.0 and likeness(print_of("a" * 9), own) == 0.0


def changed(rng, t, changes):
    """Some characters replaced, put in or left out."""
    chars = list(t)
    for _ in range(changes):
        chars[rng.randrange(len(chars))] = rng.choice(["", "x", "yz"])
    return "".join(chars)


def test_edit_classes_equal_brute_force(spark, monkeypatch):
    rng, w = random.Random(8), walker()
    docs = []
    for _ in range(10):
        base = text(rng, rng.randint(80, 200))
        docs += [base, base, changed(rng, base, 2), changed(rng, base, 5), changed(rng, base, 400)]
    docs += [None, "", "a", "a b"]
    prints = [w.fingerprint([(c, w.walk(c, 0))]) for c in (code_points(t or "") for t in docs)]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if likeness(prints[i], prints[j]) >= 0.6:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = edit_classes(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], SCHEMA))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(label))
    assert edit_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_late_walk_does_not_hide_a_copy():
    rng, w = random.Random(9), walker()
    likes = {}
    for size, shift in ((2000, 20), (500, 5)):
        bases = [text(rng, size // 3)[:size] for _ in range(40)]
        prints = w.fingerprints([code_points(t) for t in bases])
        shifted = w.fingerprints([code_points(text(rng, shift)[:shift] + t) for t in bases])
        likes[size] = [likeness(a, b) for a, b in zip(prints, shifted)]
        unrelated = [likeness(a, b) for a, b in zip(prints, shifted[1:])]
        assert np.mean(unrelated) < 0.3 and max(unrelated) < 0.6
    misses = [np.mean(np.array(v) < 0.6) for v in likes.values()]
    assert max(misses) <= 0.2  # a single walk misses 0.3 to 0.5 of both


def test_walks_side_by_side_equal_single_ones():
    rng, w = random.Random(10), walker()
    texts = [code_points(t) for t in (text(rng, 700), "", "a", text(rng, 90), "\U0001f600" * 300, text(rng, 40), text(rng, 2000))]
    starts = np.arange(len(texts))[:, None] * 70_001 + np.arange(w.walks)
    for codes, start, moves in zip(texts, starts, w.moves(texts, starts)):
        assert (w.reached(moves, start) == w.walk(codes, start)).all()


def test_registered_query_finds_copies_that_are_not_neighbours(spark, tmp_path):
    from runlens.llm.queries import QUERIES

    rng = random.Random(11)
    bases = [text(rng, rng.randint(150, 400)) for _ in range(12)]
    docs = bases + [t.replace(" ", "  ", 1) for t in bases] + [changed(rng, t, 4) for t in bases] + ["", None]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op3_edit_fingerprints"](spark, str(tmp_path)).collect()}
    assert {i: (r.class_id, r.class_size) for i, r in got.items()} == {i: (i % 12, 3) if i < 36 else (36, 2) for i in range(38)}
    assert all(r.edited_sha256 and len(r.fingerprint) == len(r.edited_fingerprint) for r in got.values())


def test_likeness_of_packed_fingerprints():
    rng, w = random.Random(12), walker()
    texts = [text(rng, 200), text(rng, 150), text(rng, 60), "", ""]
    prints = w.fingerprints([code_points(t) for t in texts + [changed(rng, t, 9) for t in texts[:3]]])
    packed = np.array([list(bytes.fromhex(p)) for p in prints], np.uint8)
    for i, p in enumerate(prints):
        assert likenesses(packed, i, np.arange(len(prints))) == pytest.approx([likeness(p, q) for q in prints])
