"""Quality, mixing, URL rules, top-k, back-off scores, archives and the pipeline; comparison SQL of all queries."""

import math
import random
from collections import Counter

import duckdb
import numpy as np

import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from conftest import DATA, rows
from runlens.llm import backoff, queries, topk, warc
from runlens.llm.backoff import backoff_scores
from runlens.llm.mixing import OTHER, mix, rake
from runlens.llm.quality import fit_quality, ftrl, probability, quality_scores
from runlens.llm.topk import search, top_k
from runlens.llm.url_rules import judge_urls
from runlens.llm.warc import LoserTree, capture_index, captures, record, sort_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


@pytest.mark.parametrize("key", list(queries.ORACLES))
def test_comparison_sql(spark, con, key):
    verdict, n, _ = compare.compare(spark, con, DATA, queries.QUERIES[key], queries.ORACLES[key])
    assert verdict == "ok" and n > 0


# ---------------------------------------------------------------- quality


def test_quality_learns_without_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    two = {r.doc_id: r for r in quality_scores(docs, other).collect()}
    assert one == two and len(one) == docs.count()
    assert any(r.held_out for r in one.values()) and all(r.predicted == (r.score >= 0.7) for r in one.values())


def test_quality_separates_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, "", ""), (1, "", "en", "s", 0, "", ""), (None, "a b", "en", "s", 3, "", "")], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert [r.score for r in got] == [0.5] * 3 and not any(r.held_out for r in got if r.doc_id is None)
    assert quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_ftrl_weights_follow_the_labels():
    x = np.array([1.0])
    model = ftrl([(np.array([i % 2]), x, i % 2) for i in range(200)], bits=3)
    assert model.weights[1] > 0 > model.weights[0] and (model.weights[2:] == 0).all()


# ---------------------------------------------------------------- mixing


def test_raking_meets_every_marginal():
    rng = np.random.default_rng(0)
    cells = rng.integers(50, 200, (3, 4, 2)).astype(float)
    goals = [rng.dirichlet([20] * n) for n in cells.shape]
    kept = cells * np.minimum(rake(cells, goals, 0.4), 1)
    assert kept.sum() == pytest.approx(0.4 * cells.sum())
    for k, goal in enumerate(goals):
        assert kept.sum(axis=tuple(a for a in range(3) if a != k)) / kept.sum() == pytest.approx(goal, rel=1e-6)
    with pytest.raises(ValueError):
        rake(np.array([[[1.0], [0.0]]]), [np.ones(1), np.array([0, 1.0]), np.ones(1)], 0.5)


def test_mixing_odd_rows(spark):
    targets = {"source": {"a": 0.5, OTHER: 0.5}, "lang": {"en": 1.0}, "topic": {"x": 0.5, OTHER: 0.5}}
    docs = spark.createDataFrame([(i, "w " * 20, "en", "ab"[i % 2], 1, "s", "r") for i in range(400)] + [(None, None, None, None, None, None, None)] * 2, DOCS)
    topic = F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y")
    got = mix(docs, targets, topic, keep=0.6)
    assert got.columns == [*docs.columns, "tokens", "weight", "probability", "selected"] and got.count() == 402
    nulls = got.where("doc_id is null").collect()
    assert nulls[0] == nulls[1] and nulls[0].tokens == 0
    expected = got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).where("source is not null").collect()
    assert [r.t for r in expected] == pytest.approx([0.3 * 8000] * 2)
    assert mix(docs.limit(0), targets, topic).count() == 0
    assert "tokens" in mix(got, targets, topic).columns


# ---------------------------------------------------------------- URL rules


def brute_verdict(url, rules):
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "ab", "org", "com"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab/", "/a,b", "/A", "/é/"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#/a', 'x'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "HTTP://A.ORG/A", "x://y://z/a", "http://a.org", "http://..", "http://a.org:80/"] + ["http://ab.org/a/b"] * 300
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_rules_of_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert rows(judge_urls(pages, rules), "page_id", "host", "verdict") == sorted([(1, "a.b", "allow")] * 2 + [(None, "", "allow")], key=repr)
    odd = spark.createDataFrame([(None, None, None), ("A.b", None, "block")], rules.schema)
    assert rows(judge_urls(pages, odd), "page_id", "rule") == sorted([(1, "a.b")] * 2 + [(None, None)], key=repr)
    assert judge_urls(pages.limit(0), odd).count() == 0


# ---------------------------------------------------------------- top-k


def brute_top(vectors, k, every):
    whole = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in whole if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 16])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "OPEN", 6)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(120)]
    vectors += [(200 + i, vectors[5][1]) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8)]
    vectors += [(500, [0.5]), (510, [0.25]), (600, []), (610, []), (700, [2.0**33] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, rank int")
    assert sorted(tuple(r) for r in top_k(df, 5, 10).collect()) == brute_top(vectors, 5, 10)
    assert top_k(df.limit(0)).count() == 0


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    vectors = [(10, [1.0, 0.0]), (10, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [1.0, 3.0]), (2, [0.0, 1.0]), (2, [5.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, rank int")
    one = 256 * 256
    # both queries with id 10 share a ranking: (1, 3) by [0, 1]; twice (2, 0) by [1, 0]; then (1, 3) by [1, 0] and 2 by [0, 1]
    want = [(10, 1, 1, 3 * one), (10, 2, 1, 2 * one), (10, 3, 1, 2 * one), (10, 4, 1, one), (10, 5, 2, one)]
    assert sorted(tuple(r) for r in top_k(df, 5, 10).collect()) == want


def test_top_k_sends_no_copy_of_a_block_for_each_shard(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "TURN", 20_000)
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist()) for i in range(800)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, rank int")
    sizes = []

    def sent(node):  # bytes that broadcasts and shuffles of a finished plan held
        name = node.getClass().getSimpleName()
        if "QueryStageExec" in name:
            return sent(node.plan())
        if name == "AdaptiveSparkPlanExec":
            return sent(node.executedPlan())
        if name in ("BroadcastExchangeExec", "ShuffleExchangeExec"):
            sizes.append(node.metrics().apply("dataSize").value())
        for i in range(node.children().size()):
            sent(node.children().apply(i))

    write = topk.saved
    monkeypatch.setattr(topk, "saved", lambda df, name: (write(df, name), df.collect(), sent(df._jdf.queryExecution().executedPlan()))[0])
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")  # the shards are larger, the queries smaller
    try:
        found = top_k(df, 5, 10)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    sent(found._jdf.queryExecution().executedPlan())
    # 80 queries in three turns: 800 vectors are 0.2 MB, shuffled in each; a hash table of the join is 1 MB at least; a block a shard made 2 MB
    assert got == brute_top(vectors, 5, 10)
    assert sizes and max(sizes) < 1_500_000


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(1)
    data = rng.integers(-5, 5, (4000, 3))
    data[:5] = [[250, 250, 250], [240, 240, 240], [230, 230, 230], [220, 220, 220], [210, 210, 210]]
    read = []
    original = topk._product
    topk._product = lambda q, x: read.append(len(x)) or original(q, x)
    try:
        found = list(search(np.array([[3, 2, 1]]), np.array([-1]), data, np.arange(4000), 5))
    finally:
        topk._product = original
    assert found[0][1].tolist() == [0, 1, 2, 3, 4] and read[-1] < 100 and len(read) == 5  # one step, then a few candidates


# ---------------------------------------------------------------- back-off scores


def brute_scores(docs):
    split = [(i, (t or "").lower().split()) for i, t in docs]
    counts = Counter(tuple(w[j : j + n]) for _, w in split for n in (1, 2, 3) for j in range(len(w) - n + 1))
    total = sum(len(w) for _, w in split)
    out = []
    for i, w in split:
        own = Counter(tuple(w[j : j + n]) for n in (1, 2, 3) for j in range(len(w) - n + 1))
        rest = lambda g, own=own: counts[g] - own[g]
        logs = []
        for j in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[j - n + 1 : j + 1])
                if n == 1:
                    logs.append(math.log(max(rest(g), 1) / max(total - len(w), 1)) + 2 * math.log(0.4))
                elif j >= n - 1 and rest(g) > 0:
                    logs.append(math.log(rest(g) / rest(g[:-1])) + (3 - n) * math.log(0.4))
                    break
        out.append((i, len(w), sum(logs) / len(w) if w and total > len(w) else None))
    return sorted(out, key=repr)


def test_back_off_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 300)
    monkeypatch.setattr(backoff, "PART_ENTRIES", 200)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, " \n"), (102, "A b C"), (102, "A b C"), (None, "zz"), (103, "q " * 3000)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in docs], DOCS)
    got = sorted((tuple(r) for r in backoff_scores(df).collect()), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in brute_scores(docs)]
    assert sorted(r[2] for r in got if r[2] is not None) == pytest.approx(sorted(r[2] for r in brute_scores(docs) if r[2] is not None))
    assert backoff_scores(df.limit(0)).count() == 0
    assert backoff_scores(df.where("doc_id = 103")).first().score is None


# ---------------------------------------------------------------- archives


def test_records_round_trip():
    members = [record(5, "http://a/ö\r\n b", "2024-01-01T00:00:00Z", b"x\r\n\r\nWARC/1.1\r\n", "d1", None), record(None, None, None, b"", "d2", None), record(7, "u", None, b"y" * 2000, "d3", 5)]
    assert all(m[-1] == 0 for m in members)
    found = list(captures(b"".join(members)))
    assert [c.payload for c in found] == [b"x\r\n\r\nWARC/1.1\r\n", b"", b""]
    assert found[0].headers["WARC-Target-URI"] == "http://a/%C3%B6%0D%0A%20b"
    assert found[2].headers["WARC-Type"] == "revisit" and found[2].headers["X-Payload-Length"] == "2000"
    assert [(c.place, c.size) for c in found] == [(sum(map(len, members[:i])), len(m)) for i, m in enumerate(members)]
    with pytest.raises(ValueError):
        list(captures(members[0][:-9]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(30))) for i in range(k)]
    assert list(LoserTree([iter(r) for r in runs], lambda e: e[0])) == sorted((e for r in runs for e in r), key=lambda e: (e[0], e[1], e[2]))


def test_index_is_globally_ordered(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ENTRIES", 30)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(9)
    same = "s" * 1500
    pages = [(i, rng.choice(["http://hot.org/", f"http://h{rng.randrange(9)}.org/p{i % 5}", None]), rng.choice([same, "small", None, str(i) * 400]), rng.randrange(50)) for i in range(400)]
    pages += [(None, "http://hot.org/", same, None), (3, pages[3][1], pages[3][2], pages[3][3])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, t int").withColumn("captured", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    got = capture_index(df.withColumn("place", F.lit(1))).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(pages)))
    keys = [sort_key(tuple(r)[2:]) for r in got]
    assert keys == sorted(keys)
    seen = Counter()
    for r in got:
        seen[r.url_key] += 1
        assert r.capture_no == seen[r.url_key]
    most = max(i for i, _, h, _ in pages if h == same and i is not None)
    for r in got:
        html = next(h for i, _, h, _ in pages if i == r.page_id) or ""
        revisit = html == same and r.page_id != most
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(html), "revisit" if revisit else "response", most if revisit else None)
    assert capture_index(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_hold_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, DATA)
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.collect()}
        before = {r.doc_id: r.text for r in now.collect()}
        assert ids <= set(before) and ids
        if name == "quality":
            model = fit_quality(now, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert ids == {r.doc_id for r in now.select("doc_id", probability(F.col("text"), model).alias("p")).collect() if r.p >= 0.5}
        elif name == "near_duplicates":
            from test_duplicates import brute_classes

            assert ids == {c for _, c, _ in brute_classes(list(before.items()))}
        else:
            sql = f"WITH RECURSIVE {queries.mix_sql('kept')} SELECT doc_id FROM mixed WHERE u < probability"
            con = duckdb.connect()
            con.register("kept", now.toArrow())
            assert ids == {r[0] for r in con.execute(sql).fetchall()}
        now = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in now.collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None



def test_reading_an_archive_takes_time_in_proportion_to_it():
    import random
    import time

    rng = random.Random(0)
    one = b"".join(record(i, f"http://a.org/{i}", None, rng.randbytes(4000), "0" * 40, None)[:-1] + b"\0" for i in range(500))
    took = []
    for n in (2, 16):
        start = time.perf_counter()
        found = list(captures(one * n))
        took.append((time.perf_counter() - start) / n)
        assert len(found) == 500 * n and found[3].payload == found[503].payload and found[-1].place + found[-1].size == len(one * n)
    assert took[1] < 4 * took[0]


@pytest.mark.parametrize("name", ["_id", "_key", "_source", "_lang", "_topic", "label", "row"])
def test_stages_keep_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 9, "kept"), (2, "one two three four five six", "en", "s", 9, "gone"), (3, None, None, None, None, "kept"), (None, "", "de", "t", 0, "kept")], f"doc_id long, text string, lang string, source string, n_chars long, {name} string")
    left = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert sorted((r.doc_id or 0, r[name]) for r in left.collect()) == [(1, "kept"), (3, "kept")]
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.mixing):
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns and stage(spark, docs.limit(0), DATA).count() == 0
    assert {r[name] for r in corpus_pipeline.mixing(spark, docs, DATA).collect()} <= {"kept", "gone"}


def test_powers_of_a_source_are_its_target(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "big" if i % 10 else "small") for i in range(2000)], "doc_id long, text string, lang string, source string")
    mixed = mix(docs, {"source": 0.5, "lang": {"en": 1.0}, "topic": {OTHER: 1.0}}, F.lit("x"), keep=0.2)
    kept = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("n")).collect()}
    assert kept["big"] / kept["small"] == pytest.approx(3, rel=1e-6) and sum(kept.values()) == pytest.approx(4000)


def test_scores_equal_features_and_updates_in_a_dictionary():
    """Features of a few texts word by word, and the fit coordinate by coordinate."""
    import pyarrow as pa

    from runlens.llm.quality import features
    from runlens.llm.words import ngrams, word_hashes

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Good", "good", "bad", "fine", "x"]) for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["", None]
    at, x, offsets = features(pa.array(texts), 10)
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        single = [int(h) >> 54 for h in word_hashes(pa.array([text]))[0]]
        pairs = [int(h) >> 54 for h in ngrams(*word_hashes(pa.array([text])), 2)[0]]
        assert len(single) == len(words) and len(pairs) == max(len(words) - 1, 0)
        counts = {k: math.log1p(n) for k, n in Counter(single + pairs).items()}
        norm = math.sqrt(sum(v * v for v in counts.values()))
        got = dict(zip(at[offsets[i] : offsets[i + 1]].tolist(), x[offsets[i] : offsets[i + 1]]))
        assert got == pytest.approx({k: v / norm for k, v in counts.items()})

    rows = [(at[s:e], x[s:e], rng.randrange(2)) for s, e in zip(offsets, offsets[1:])]
    model = ftrl(rows, bits=10)
    alpha, beta, l1, l2, z, n = 2.0, 1.0, 0.02, 0.02, Counter(), Counter()

    def weight(i):
        if i != "bias" and abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (0 if i == "bias" else math.copysign(l1, z[i]))) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(4):
        for ids, values, y in rows:
            both = [*zip(ids.tolist(), values.tolist()), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in both}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in both)))
            for i, v in both:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert model.weights == pytest.approx([weight(i) for i in range(1 << 10)], abs=1e-5) and model.bias == pytest.approx(weight("bias"))
