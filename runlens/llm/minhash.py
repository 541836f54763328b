"""Near duplicates by DartMinHash signatures of weighted word shingles.

A text is the weighted set of its five-word shingles (lower case, parted at white space), the weight
being the count. Think of each element as a strip as wide as its weight, in which darts lie at random
heights: the darts below a height that depends on the total weight alone are thrown by hashes of
(element, unit of weight, band of heights), so texts that share an element share its darts. Every dart
falls on one of the signature's coordinates, each coordinate keeps its lowest dart, and the chance
that two texts keep the same one is their weighted Jaccard similarity. The work is one small draw an
element plus the darts, not elements times coordinates.

Equal texts (same words) count once. Signatures are banded; in a bucket each text meets the smallest
and the largest id, pairs are checked exactly on their shingles, and links become components. Buckets
that still hold several components go through all their cross pairs, block by block inside numpy, by
the agreement of whole signatures; what may reach the similarity is checked exactly there as well. So
no bucket is capped, and no pairs within a group of copies are written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import linked_labels, named_classes
from .common import prepare, saved, slices, trimmed, unused
from .words import mix, ngrams, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
LOWEST = -10  # the lowest band of heights is [0, 2**LOWEST)
BLOCK = 1000  # members of a bucket that are compared with another block at a time
SLACK = 0.15  # over 4.7 standard deviations of a signature's estimate at 0.8


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(shingle hashes, offsets, digests of the word sequences). A text of fewer than ``n`` words is one
    shingle; without words it has none."""
    hashes, offsets = word_hashes(texts)
    grams, gram_offsets = ngrams(hashes, offsets, n)
    counts = np.diff(offsets)
    digests = [hashlib.blake2b(hashes[s:e].tobytes(), digest_size=16).digest() for s, e in zip(offsets, offsets[1:])]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.array([int.from_bytes(digests[i][:8], "little") for i in short], dtype=np.uint64)
        grams = np.insert(grams, gram_offsets[short], whole)
        gram_offsets = gram_offsets + np.append(0, np.cumsum((counts > 0) & (counts < n)))
    return grams, gram_offsets, digests


def weighted(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight) of the distinct elements of each row, sorted by row and element."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    first = np.flatnonzero(new)
    return rows[first], grams[first], np.diff(np.append(first, len(rows)))


def _poisson(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities, up to where they are one in double precision."""
    out, p, total, i = [], np.exp(-mean), 0.0, 0
    while i < 10 or (total < 1 - 1e-15 and p > 1e-300):
        total += p
        out.append(total)
        i += 1
        p *= mean / i
    return np.array(out)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """``n_rows`` signatures of ``k`` 32-bit numbers from (row, element, integer weight); rows without
    elements have zeros."""
    out = np.zeros((n_rows, k), np.uint32)
    units = np.repeat(elements, weights)
    unit_rows = np.repeat(rows, weights)
    starts = np.cumsum(weights) - weights
    level = np.arange(len(units)) - np.repeat(starts, weights)
    units = mix(units + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.bincount(unit_rows, minlength=n_rows)
    # so many darts leave a coordinate empty with probability about e**-2 over all
    need = k * np.log(k) + 2 * k
    top = np.zeros(n_rows, np.int64)
    some = total > 0
    top[some] = np.maximum(np.ceil(np.log2(need / total[some])), LOWEST).astype(np.int64)
    waiting = some
    while waiting.any():
        best = np.full(n_rows * k, np.inf)
        value = np.zeros(n_rows * k, np.uint32)
        chosen = waiting[unit_rows]
        own_units, own_rows = units[chosen], unit_rows[chosen]
        for band in range(LOWEST, int(top[waiting].max()) + 1):
            low, high = (0.0, 2.0**LOWEST) if band == LOWEST else (2.0 ** (band - 1), 2.0**band)
            inside = top[own_rows] >= band
            if not inside.all():
                own_units, own_rows = own_units[inside], own_rows[inside]
            drawn = mix(own_units ^ mix(np.array([band + 1000], np.uint64))[0])
            darts = np.searchsorted(_poisson(high - low), _uniform(drawn), side="right")
            hit = np.flatnonzero(darts)
            seeds = np.repeat(drawn[hit], darts[hit])
            number = np.arange(len(seeds)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
            seeds = mix(seeds + (number + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            height = low + (high - low) * _uniform(mix(seeds ^ np.uint64(0x5851F42D4C957F2D)))
            at = np.repeat(own_rows[hit], darts[hit]) * k + (seeds % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, height)
            won = best[at] == height
            value[at[won]] = (seeds[won] >> np.uint64(32)).astype(np.uint32)
        full = np.isfinite(best).reshape(n_rows, k).all(axis=1) & waiting
        out[full] = value.reshape(n_rows, k)[full]
        waiting = waiting & ~full
        top[waiting] += 1
    return out


def pack_elements(elements: np.ndarray, weights: np.ndarray) -> bytes:
    """Distinct elements by their upper 32 bits, and their weights unless all are one."""
    short = (elements >> np.uint64(32)).astype("<u4")
    return short.tobytes() if (weights == 1).all() else b"w" + short.tobytes() + weights.astype("<u4").tobytes()


def unpack_elements(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(packed) % 4 == 0:
        elements = np.frombuffer(packed, "<u4")
        return elements, np.ones(len(elements), np.int64)
    both = np.frombuffer(packed, "<u4", offset=1)
    return both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of packed elements; 1 for two empty sets."""
    (x, wx), (y, wy) = unpack_elements(a), unpack_elements(b)
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    same = x[at] == y if len(x) else np.zeros(len(y), bool)
    common = int(np.minimum(wx[at[same]], wy[same]).sum()) if same.any() else 0
    union = int(wx.sum() + wy.sum()) - common
    return common / union if union else 1.0


def sketch(docs: DataFrame, k: int = BANDS * ROWS, n: int = SHINGLE) -> DataFrame:
    """One row a document: ``row`` (a number of its own), doc_id, text_key (hash of the text), k1 and k2 (digest of the words),
    ``signature`` and ``elements``; the last two are null for texts without words."""
    prepare(docs.sparkSession)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("signature", pa.binary()), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                grams, offsets, digests = shingles(part.column("text"), n)
                rows, elements, weights = weighted(grams, offsets)
                signed = signatures(rows, elements, weights, part.num_rows, k)
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                packed = [pack_elements(elements[s:e], weights[s:e]) if e > s else None for s, e in zip(at, at[1:])]
                signed_bytes = [signed[i].tobytes() if e > s else None for i, (s, e) in enumerate(zip(at, at[1:]))]
                cols = [part.column("row"), part.column("doc_id"), part.column("text_key"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(signed_bytes, pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    key = F.xxhash64("text").alias("text_key")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key, "text")
    return numbered.mapInArrow(trimmed(run), "row long, doc_id long, text_key long, k1 long, k2 long, signature binary, elements binary")


def _band_keys(sketches: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, row) of every band of every signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, bands, rows).astype(np.uint64)
            keys = np.zeros(signed.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for i in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, i])
            cols = [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.array(batch.column("row"), dtype=np.int64), bands))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "row"])

    return sketches.select("row", "signature").mapInArrow(trimmed(run), "key long, row long")


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``row`` number, doc_id, text_key, label, class_id, class_size of every document (doc_id, text).

    Two documents are linked if the weighted Jaccard similarity of their five-word shingles is at least
    ``least``; classes are the connected components and are named by their smallest doc_id (null if all
    are null). Texts with the same words are always in one class, so null, empty and blank texts are
    one. Repeated doc_ids are rows of their own. An empty table gives no rows."""
    k = bands * rows
    sketches = saved(sketch(docs, k), "sketches")
    alike = saved(sketches.groupBy("k1", "k2").agg(F.min("row").alias("first")), "equal-texts")
    members = saved(sketches.select("row", "doc_id", "text_key", "k1", "k2").join(alike, ["k1", "k2"]).select("row", "doc_id", "text_key", "first"), "members")
    # one of equal texts goes on; of its sketch only the signature is moved
    signed = sketches.where("signature is not null").select("row", "signature")
    single = signed.join(alike.select(F.col("first").alias("row")), "row", "left_semi")
    def agreement(signed: list[bytes], i: int, at: np.ndarray) -> np.ndarray:
        own = np.frombuffer(signed[i], "<u4")
        equal = (np.frombuffer(b"".join([signed[j] for j in at]), "<u4").reshape(-1, k) == own).sum(axis=1) / k
        return equal - (least - SLACK)

    kept = sketches.where("signature is not null").select("row", "signature", F.col("elements").alias("content"))
    labels = linked_labels(_band_keys(single, bands, rows), kept, agreement, lambda x, y: similarity(x, y) >= least, BLOCK)
    return named_classes(members, labels)


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``near_duplicate_classes``, with all its columns: that of the smallest
    doc_id (null comes last), and among rows with this doc_id that of the smallest text hash. An empty table
    stays empty, and no column name clashes."""
    rows = saved(near_duplicate_classes(docs, least), "classes-of-rows")
    # null ids last, by a number beyond every other
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    first = saved(rows.groupBy("label").agg(F.min("_id").alias("_id")), "first-ids")
    named = rows.join(first, ["label", "_id"], "left_semi").groupBy("label", "_id").agg(F.min("text_key").alias("_key"))
    kept = saved(named.select("_id", "_key").distinct(), "kept-rows")
    id_, key = unused(docs.columns, "id", "key")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), key: F.xxhash64("text")})
    left = keyed.join(kept.toDF(id_, key), [id_, key], "left_semi")
    if rows.groupBy("_id", "text_key").count().where("count > 1").isEmpty():
        return left.select(*docs.columns)
    return left.dropDuplicates([id_, key]).select(*docs.columns)  # the same document more than once
