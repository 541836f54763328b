"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words and word pairs (parted at white space, lower case), hashed into
``2**bits`` numbers; values are log-scaled counts of unit length. Only the text enters. A model is a
vector of that fixed size, so it is the same to broadcast whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, trim, trimmed
from .words import ngrams, word_hashes

BITS = 18
MAX_ROWS = 24_000  # labelled rows that training looks at, at most: those with the smallest hashes of doc_id
EPOCHS = 4


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**bits
    bias: float
    bits: int


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, offsets) of texts; the values of a text have unit length."""
    hashes, offsets = word_hashes(texts)
    pairs, pair_offsets = ngrams(hashes, offsets, 2)
    rows = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.repeat(np.arange(len(offsets) - 1), np.diff(pair_offsets))])
    keys = (np.concatenate([hashes, pairs]) >> np.uint64(64 - bits)).astype(np.int64) | rows << bits
    keys, counts = np.unique(keys, return_counts=True)
    rows, values = keys >> bits, np.log1p(counts)
    norms = np.sqrt(np.bincount(rows, values * values, minlength=len(offsets) - 1))
    values = values / norms[rows]
    return keys & ((1 << bits) - 1), values, np.searchsorted(rows, np.arange(len(offsets)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 2.0,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """One pass after another of per-coordinate FTRL-proximal over (numbers, values, label). Without
    both labels the model says one half to every text."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    labels = [y for _, _, y in examples]
    positive = sum(labels)
    if not 0 < positive < len(labels):
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits)

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in examples:
            w, b = solve(z[at], n[at]), -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - y) * x
            gb = p - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
    bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    return Model(solve(z, n).astype(np.float32), float(bias), bits)


def train(labelled: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Fit on all rows of ``labelled`` (doc_id, text, label 0 or 1), a sample that the caller has
    bounded; rows with another label or a null doc_id are passed over. The features of the texts, not
    the texts, reach one training task, in the order of a hash of doc_id."""
    prepare(labelled.sparkSession)
    rows = labelled.where("label in (0, 1) and doc_id is not null")
    keyed = rows.select(F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, x, offsets = features(part.column("text"), bits)
                rows = [(at[s:e].astype("<i4").tobytes(), x[s:e].astype("<f4").tobytes()) for s, e in zip(offsets, offsets[1:])]
                cols = [part.column("label"), part.column("h"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["label", "h", "at", "x"])

    def fit(t: pa.Table) -> pa.Table:
        order = np.lexsort((np.array(t["label"]), np.array(t["h"])))
        rows = t.take(pa.array(order)).to_pylist()
        model = ftrl([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4").astype(float), r["label"]) for r in rows], bits, epochs)
        return pa.table({"bias": [model.bias], "weights": pa.array([model.weights.tobytes()], pa.binary())})

    spread = keyed.mapInArrow(trimmed(extract), "label int, h long, at binary, x binary")
    found = spread.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "bias double, weights binary").collect()
    if not found:
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits)
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"], bits)


def probability(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text, null as empty; an empty text has the bias alone."""
    shared = model

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for part in slices(batch, "text"):
            at, x, offsets = features(part.column("text"), shared.bits)
            sums = np.append(0.0, np.cumsum(shared.weights[at] * x))
            out.append(1 / (1 + np.exp(-np.clip(sums[offsets[1:]] - sums[offsets[:-1]] + shared.bias, -35, 35))))
        trim()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def in_held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


#: Least score of a document that counts as good.
THRESHOLD = 0.7


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model fit on the labelled ones
    outside the held-out fold. Repeated doc_ids are scored each; a null doc_id is not held out. An empty
    table gives no rows, and without any label every score is 0.5."""
    model = fit_quality(docs, labels)
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(in_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        probability(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of ``labels.quality``. Which labelled rows are used is settled on the labels alone,
    by hash and before any text is read; at most ``max_rows`` ids are then looked up in the documents."""
    own = labels.where(F.col("quality").isin(0, 1) & ~in_held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("least")).where("label = least").drop("least")
    keyed = own.withColumn("h", F.xxhash64("doc_id"))
    picked = keyed.orderBy("h", "doc_id").limit(max_rows).drop("h")
    # at most max_rows rows of two numbers, so the side to broadcast is bounded
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # one text for a repeated doc_id keeps the bound
    return train(labelled.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
