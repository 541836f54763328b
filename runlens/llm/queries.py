"""The registered queries of the corpus operators and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff import backoff_scores
from .common import table
from .edit_fingerprints import edits_and_classes
from .jaccard import jaccard_components
from .merkle import build_manifest, digest_of, proofs, verified
from .minhash import near_duplicate_classes
from .mixing import OTHER, mix
from .packing import pack_documents
from .periodic import periodic_runs, planted
from .quality import quality_scores
from .token_files import read_tokens, write_tokens
from .topk import top_k
from .url_rules import judge_urls
from .warc import capture_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(key: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query("op7_token_files")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder, ranks = write_tokens(docs, public_tokenizers.path(VOCABULARY))
    return read_tokens(spark, folder, ranks, digest=True)


@query("op2_best_fit_packing")
def _(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op10_quality_scores")
def _(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_top_k_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def _(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op5_url_rules", """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest
), fits AS (
  SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)
""")
def _(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op3_edit_fingerprints")
def _(spark, sf_dir):
    return edits_and_classes(table(spark, sf_dir, "documents"))


@query("op8_dart_minhash")
def _(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query("op1_warc_index_merge", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS kept FROM p WHERE octet_length(payload) >= 1000 GROUP BY payload)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN g USING (payload)
""")
def _(spark, sf_dir):
    # the table has no time of capture: one second a page
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    index = capture_index(table(spark, sf_dir, "pages").withColumn("captured", captured))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Sources by the square root of their tokens, so a hot one gives way; the others away from what the data hold.
MIX_TARGETS = {
    "source": 0.5,
    "lang": {"en": 0.46, "de": 0.20, "fr": 0.19, "es": 0.15},
    "topic": {"prose": 0.80, "figures": 0.10, "table": 0.06, "licence": 0.04},
}


def topic_of(text):
    """What a text looks like, as its topic: the test corpus has no topic of its own."""
    kind = F.when(F.contains(text, F.lit("|")), "table").when(F.contains(text, F.lit("License")), "licence")
    return kind.when(text.rlike("[0-9]"), "figures").otherwise("prose")


def mix_sql(docs: str, keep: float = 0.5, rounds: int = 200) -> str:
    """The mix as CTEs over a table: raking as a recursion over the cells, three axes a round."""
    fixed = {axis: shares for axis, shares in MIX_TARGETS.items() if axis != "source"}
    goals = " UNION ALL ".join(
        f"SELECT '{axis}' AS axis, '{name}' AS name, CAST({share} AS DOUBLE) AS share" for axis, shares in fixed.items() for name, share in shares.items()
    ) + f" UNION ALL SELECT 'source', s, power(sum(n), {MIX_TARGETS['source']}) FROM mix_cells GROUP BY s"
    named = {axis: ", ".join(f"'{n}'" for n in shares if n != OTHER) for axis, shares in fixed.items()}
    step = lambda w, goal, now: f"least({w} * CASE WHEN {now} > 0 THEN {goal} / {now} ELSE 1 END, 1e6)"
    return f"""
mix_docs AS (
  SELECT *, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '')) AS BIGINT) AS tokens,
    CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, 'License') THEN 'licence'
      WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic FROM {docs}
), mix_keyed AS (
  SELECT *, coalesce(source, '{OTHER}') AS s,
    CASE WHEN lang IN ({named['lang']}) THEN lang ELSE '{OTHER}' END AS l,
    CASE WHEN topic IN ({named['topic']}) THEN topic ELSE '{OTHER}' END AS t FROM mix_docs
), mix_cells AS (SELECT s, l, t, CAST(sum(tokens) AS DOUBLE) AS n FROM mix_keyed GROUP BY ALL HAVING sum(tokens) > 0),
goals AS ({goals}),
mix_goals AS (
  SELECT axis, name, share / sum(share) OVER (PARTITION BY axis) * (SELECT sum(n) FROM mix_cells) * {keep} AS goal FROM goals
  WHERE (axis = 'source' AND name IN (SELECT s FROM mix_cells)) OR (axis = 'lang' AND name IN (SELECT l FROM mix_cells))
    OR (axis = 'topic' AND name IN (SELECT t FROM mix_cells))
), mix_start AS (
  SELECT c.*, coalesce(gs.goal, 0) AS gs, coalesce(gl.goal, 0) AS gl, coalesce(gt.goal, 0) AS gt FROM mix_cells c
  LEFT JOIN mix_goals gs ON gs.axis = 'source' AND gs.name = s LEFT JOIN mix_goals gl ON gl.axis = 'lang' AND gl.name = l
  LEFT JOIN mix_goals gt ON gt.axis = 'topic' AND gt.name = t
), raked AS (
  SELECT 0 AS i, s, l, t, n, gs, gl, gt, CAST({keep} AS DOUBLE) AS w FROM mix_start
  UNION ALL
  SELECT i + 1, s, l, t, n, gs, gl, gt, {step('w2', 'gt', 'zt')} AS w FROM (
    SELECT *, sum(n * least(w2, 1)) OVER (PARTITION BY t) AS zt FROM (
      SELECT *, {step('w1', 'gl', 'zl')} AS w2 FROM (
        SELECT *, sum(n * least(w1, 1)) OVER (PARTITION BY l) AS zl FROM (
          SELECT *, {step('w', 'gs', 'zs')} AS w1 FROM (
            SELECT *, sum(n * least(w, 1)) OVER (PARTITION BY s) AS zs FROM raked WHERE i < {rounds})))))
), mix_weights AS (SELECT s, l, t, w FROM raked WHERE i = {rounds}),
mixed AS (
  SELECT d.*, coalesce(w, {keep}) AS weight, least(coalesce(w, {keep}), 1.0) AS probability,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM mix_keyed d LEFT JOIN mix_weights USING (s, l, t)
)"""


@query("op4_source_mixing", f"""
WITH RECURSIVE {mix_sql('documents')}
SELECT doc_id, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, CAST(u < probability AS INT) AS selected FROM mixed
""")
def _(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"), MIX_TARGETS, topic_of(F.col("text")))
    return mixed.select("doc_id", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def backoff_sql(order: int = 3) -> str:
    """Counts of all n-grams less the document's own, joined to each word's n-grams."""
    gram = lambda n: " || ' ' || ".join(f"w{k}" for k in range(n - 1, -1, -1))
    words = ", ".join(f"lag(w, {k}) OVER (PARTITION BY k ORDER BY i) AS w{k}" for k in range(order))
    ctes = [
        "d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x20]+'), lambda w: w <> '') AS ws FROM documents)",
        "e AS (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d)",
        f"p AS (SELECT k, i, {words} FROM e)",
        "t AS (SELECT count(*) AS total FROM e)",
    ]
    for n in range(1, order + 1):
        ctes += [
            f"o{n} AS (SELECT k, {gram(n)} AS g, count(*) AS c FROM p WHERE w{n - 1} IS NOT NULL GROUP BY ALL)",
            f"a{n} AS (SELECT k, g, sum(c) OVER (PARTITION BY g) - c AS c FROM o{n})",
        ]
    joins = ""
    for n in range(1, order + 1):
        joins += f" LEFT JOIN a{n} ON a{n}.k = p.k AND a{n}.g = {gram(n).replace('w', 'p.w')}"
    shifted = ", ".join(f"lag(c{n}) OVER (PARTITION BY k ORDER BY i) AS x{n}" for n in range(1, order))
    cases = " ".join(f"WHEN c{n} > 0 THEN ln(c{n} / x{n - 1}) + {order - n} * ln(0.4)" for n in range(order, 1, -1))
    ctes += [
        "j AS (SELECT p.k, p.i, " + ", ".join(f"CAST(a{n}.c AS DOUBLE) AS c{n}" for n in range(1, order + 1)) + f" FROM p{joins})",
        f"s AS (SELECT *, {shifted} FROM j)",
        f"m AS (SELECT s.k, CASE {cases} ELSE ln(greatest(c1, 1) / greatest(total - len(ws), 1)) + {order - 1} * ln(0.4) END AS v FROM s JOIN d USING (k), t)",
        "r AS (SELECT k, avg(v) AS score FROM m GROUP BY k)",
    ]
    return "WITH " + ", ".join(ctes) + " SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(CASE WHEN total > len(ws) THEN score END, 6) AS score FROM d LEFT JOIN r USING (k), t"


@query("op9_backoff_scores", backoff_sql())
def _(spark, sf_dir):
    scores = backoff_scores(table(spark, sf_dir, "documents"))
    return scores.withColumn("score", F.round("score", 6))


@query("op13_periodic_runs")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    # greatest length, then smallest start, then smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digests = {"runs_sha256": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), "collapsed_sha256": F.col("collapsed")}
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"), F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"), F.floor(F.lit(1000) * F.col("longest.n") / -F.col("longest.p")).alias("exponent_milli"),
        *[F.sha2(c.cast("binary"), 256).alias(name) for name, c in digests.items()],
    )


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text: the polynomial's eight steps for each byte."""
    step = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda crc, b: list_reduce(range(8), {step}, xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"


def merkle_sql() -> str:
    """The trees level by level as recursions, every proof as a list of steps that is folded."""
    def leaf(n_chars: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
        return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({f})) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (
  SELECT g, 0 AS lvl, r AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 2
)"""

    def steps(nodes: str, r: str) -> str:
        return f"""list(CASE WHEN s.h IS NULL THEN '-' WHEN ({r} >> t.lvl) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY t.lvl) FILTER (WHERE t.n > 1)"""

    def siblings(name: str, leaves: str, nodes: str) -> str:
        return f"""{name} AS (
  SELECT l.g, l.r, coalesce({steps(nodes, 'l.r')}, []) AS path FROM {leaves} l JOIN {nodes} t ON t.g = l.g AND t.i = l.r >> t.lvl
  LEFT JOIN {nodes} s ON s.g = t.g AND s.lvl = t.lvl AND s.i = xor(t.i, 1) GROUP BY l.g, l.r
)"""

    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf('n_chars')} AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {leaf('n_chars + 1')} END AS claimed FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
{tree('nodes', 'leaves')},
subroots AS (SELECT g AS lang_key, h AS leaf, 'all' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS r FROM nodes WHERE n = 1),
{tree('tops', 'subroots')},
{siblings('own', 'leaves', 'nodes')}, {siblings('upper', 'subroots', 'tops')},
paths AS (
  SELECT doc_id, l.leaf, coalesce(claimed, l.leaf) AS claimed, s.leaf AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, own.path || upper.path AS path
  FROM leaves l JOIN own USING (g, r) JOIN subroots s ON s.lang_key = l.g JOIN upper ON upper.r = s.r
), folded AS (
  SELECT *, sha256(list_aggregate(list_transform(list_filter(path, lambda s: s <> '-'), lambda s: substr(s, 2)), 'string_agg', '')) AS some_proof,
    list_reduce(path, lambda h, s: sha256(CASE s[1] WHEN 'L' THEN substr(s, 2) || h WHEN 'R' THEN h || substr(s, 2) ELSE h END), claimed) AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, coalesce(some_proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


@query("op11_merkle_manifest", merkle_sql())
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    row = lambda n_chars: digest_of("doc_id", "source", "lang", n_chars, "text")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("key"), row("n_chars").alias("leaf"),
        F.when(tampered, row(F.col("n_chars") + 1)).alias("claimed"),
    )
    found = verified(proofs(build_manifest(rows)))
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof_digest": "proof_sha256", "folded": "folded_root"}
    return found.select(F.col("key").alias("doc_id"), *[F.lower(F.hex(c)).alias(name) for c, name in names.items()], "verified")


@query("op12_jaccard_components", """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT k, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s FROM d
), whole AS (SELECT min(k) AS k, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
one AS (SELECT k, len(s) AS n, unnest(s) AS w FROM whole),
links AS (
  SELECT a.k AS a, b.k AS b FROM one a JOIN one b ON a.w = b.w AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.k, b.k HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT k, k FROM whole UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON w.a = r.b),
labels AS (SELECT a AS k, min(b) AS label FROM reached GROUP BY a),
named AS (
  SELECT sets.k, doc_id, len(sets.s) AS n, coalesce(label, sets.k) AS label FROM sets LEFT JOIN whole ON list_sort(sets.s) = whole.s LEFT JOIN labels ON labels.k = whole.k
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(doc_id) OVER (PARTITION BY label, CASE WHEN n = 0 THEN k END) AS component_id FROM named
""")
def _(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
