"""Exact Jaccard join of documents by their word shingles, as a join in a metric space.

One minus the Jaccard similarity is a metric, and two documents are linked within EPS of each other.

1. *Pivots and Voronoi regions.* A bounded sample of the distinct sets, thinned until all are more than
   RADIUS apart, are the pivots. A set within RADIUS of a pivot belongs to the region of its nearest one.
2. *Windows.* By the triangle inequality a set can only be linked to one in the region of pivot p if its
   distance to p is at most RADIUS + EPS, and at most its nearest distance + 2 EPS. So it is copied to these
   regions and no others: the sets near a boundary. A set within EPS of a pivot is linked to it at once.
3. *The far region, recursively.* Sets beyond RADIUS of all pivots are mostly at distance 1 from each other,
   where sampled pivots part nothing. There the space is split instead: shingles are dealt into classes,
   and the distance within a class is again a Jaccard metric. Linked sets of a and b shingles differ in at
   most (a + b) / 9 shingles, so in at most so many classes. In each class every set that occurs is a pivot
   of its own, and its region the documents at distance 0 from it. Classes have an order, and a set visits
   the regions of its first D + 1 classes that aren't empty, D being that bound: before the first class
   in which two linked sets agree, each class that isn't empty for one of them is one in which they differ.
   A set with at most D such classes visits the common region of all of these as well. Two such sets that
   agree in no class meet there.
   The number of classes follows the size, by powers of two; a set whose partners may have the next lower
   power visits regions there too. Shingles that are common in the sample have classes of their own, last
   in the order, so that a passage in very many documents makes no large regions.
4. *Exact joins within regions*, by the stars, components and blocks of ``banding``; pairs are passed over
   if a bound of their symmetric difference (parities of shingles) excludes them.

Nothing depends on chance but the speed: all linked pairs share a region. Shingles are told apart by 48
bits of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import linked_labels
from .common import prepare, saved, saved_by, shuffle_partitions, slices, trimmed
from .words import ASCII_LOWER, BASE, SPACED, mix, ngrams, word_hashes

SHINGLE = 5
LEAST = 80  # percent of the union that linked sets share
EPS = 1 - LEAST / 100
RADIUS = 0.5
SAMPLE = 1024  # distinct sets that the pivots and the common shingles are taken from
SAMPLE_SHINGLES = 1 << 20  # the sample ends before so many shingles
COMMON = 4  # sets of the sample that make a shingle common
PART_KEYS = 2_000_000  # keys of regions that one task compares
SKETCH_BITS = 1024  # of a small set
SLACK = 1e-9  # distances are ratios of small whole numbers, compared in double precision
SEED = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, 48 bits, ascending within each text; offsets). Fewer than ``n`` words are one shingle."""
    hashes, offsets = word_hashes(texts, in_word=SPACED, letters=ASCII_LOWER)
    counts = np.diff(offsets)
    grams, gram_offsets = ngrams(hashes, offsets, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(hashes[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short]
        grams = np.insert(grams, gram_offsets[short], np.array(whole, np.uint64))
        gram_offsets = gram_offsets + np.append(0, np.cumsum((counts > 0) & (counts < n)))
    rows = np.repeat(np.arange(len(counts)), np.diff(gram_offsets))
    grams = grams >> np.uint64(16)
    order = np.argsort(grams)
    order = order[np.argsort(rows[order], kind="stable")]  # few distinct rows: a radix sort
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(rows[new], np.arange(len(counts) + 1))


def pack(elements: np.ndarray) -> bytes:
    """Ascending 48-bit numbers, the upper 32 bits of all first."""
    return (elements >> np.uint64(16)).astype("<u4").tobytes() + (elements & np.uint64(0xFFFF)).astype("<u2").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(packed, "<u2", n, 4 * n)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def linked(a: int, b: int, common: int) -> bool:
    """Whether sets of ``a`` and ``b`` elements with so many in common are linked."""
    return common > 0 and 100 * common >= LEAST * (a + b - common)


def alike(one: bytes, other: bytes) -> bool:
    a, b = len(one) // 6, len(other) // 6
    return 100 * min(a, b) >= LEAST * max(a, b) and linked(a, b, shared(unpack(one), unpack(other)))


def most_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most elements in which linked sets of so many elements differ."""
    return (100 - LEAST) * (a + b) // (100 + LEAST)


def sketch(elements: np.ndarray) -> bytes:
    """Number of elements, then the parity of the elements that fall on each of at least twice as many bits, a power of
    two. Sets differ in at least as many elements as their parities do in bits."""
    width = max(SKETCH_BITS, 1 << (2 * len(elements) - 1).bit_length())
    bits = np.bincount((mix(elements) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.array([len(elements)], "<u4").tobytes() + np.packbits(bits.astype(np.uint8)).tobytes()


def _folded(parities: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities as if their sketch had ``width`` bytes."""
    while parities.shape[-1] > width:
        half = parities.shape[-1] // 2
        parities = parities[..., :half] ^ parities[..., half:]
    return parities


def agreement(signed: list[bytes], i: int, at: np.ndarray) -> np.ndarray:
    """Differences that a link allows less those that the parities show; negative where no link is possible."""
    own, out = int.from_bytes(signed[i][:4], "little"), np.full(len(at), -1.0)
    n = np.array([int.from_bytes(signed[j][:4], "little") for j in at], np.int64)
    near = np.flatnonzero(100 * np.minimum(n, own) >= LEAST * np.maximum(n, own))
    lengths = np.array([len(signed[at[k]]) - 4 for k in near], np.int64)
    mine = np.frombuffer(signed[i], np.uint8, offset=4)
    for length in np.unique(lengths):
        same = near[lengths == length]
        table = np.frombuffer(b"".join([signed[at[k]] for k in same]), np.uint8).reshape(len(same), -1)[:, 4:]
        width = min(length, len(mine))
        bits = np.bitwise_count(_folded(table, width) ^ _folded(mine, width)).sum(axis=1, dtype=np.int64)
        out[same] = most_apart(n[same], own) - bits
    return out


class Pivots:
    """Pivots as one sorted list of shingles: distances of many sets at once, without those at distance 1."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owners = shingles[order], owners[order]
        self.there = np.zeros(1 << 22, bool)  # whether a shingle with these upper bits may be there
        self.there[self.shingles >> np.uint64(26)] = True

    def near(self, elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, distance) of all pairs with a shingle in common."""
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        may = np.flatnonzero(self.there[elements >> np.uint64(26)])
        first, last = (np.searchsorted(self.shingles, elements[may], side) for side in ("left", "right"))
        hits = last - first
        at = np.repeat(first, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        pairs = np.repeat(rows[may], hits) * max(len(self.sizes), 1) + self.owners[at]
        pairs, common = np.unique(pairs, return_counts=True)
        row, pivot = np.divmod(pairs, max(len(self.sizes), 1))
        union = np.diff(offsets)[row] + self.sizes[pivot] - common
        return row, pivot, 1 - common / union

    def regions(self, elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, distance) of the regions that each set belongs or is copied to, and its nearest distance."""
        row, pivot, distance = self.near(elements, offsets)
        nearest = np.ones(len(offsets) - 1)
        np.minimum.at(nearest, row, distance)
        inside = distance <= np.minimum(nearest[row] + 2 * EPS, RADIUS + EPS) + SLACK
        return row[inside], pivot[inside], distance[inside], nearest


def thinned(sets: list[np.ndarray]) -> list[int]:
    """Numbers of the sets that are more than RADIUS from every one chosen before."""
    if not sets:
        return []
    offsets = np.append(0, np.cumsum([len(s) for s in sets]))
    row, other, distance = Pivots(sets).near(np.concatenate(sets), offsets)
    close = [set() for _ in sets]
    for i, j in zip(row[distance <= RADIUS].tolist(), other[distance <= RADIUS].tolist()):
        close[i].add(j)
    chosen: set[int] = set()
    for i in range(len(sets)):
        if not close[i] & chosen:
            chosen.add(i)
    return sorted(chosen)


def region_keys(elements: np.ndarray, rows: np.ndarray, sizes: np.ndarray, level: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the regions that sets visit among the classes of ``level`` (a power of two for each row).

    ``elements`` with their ``rows`` (ascending numbers into ``sizes`` and ``level``)."""
    top = 2 << level  # sizes of the level are below
    classes = np.where(top <= 32, top, top // 3).astype(np.uint64)
    drawn = mix(elements ^ SEED)
    own = level[rows]
    late = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] == elements if len(common) else np.zeros(len(elements), bool)
    place = drawn % classes[rows] + np.where(late, classes[rows], np.uint64(0))
    joined = rows.astype(np.uint64) << np.uint64(40) | place
    order = np.argsort(joined, kind="stable")
    joined, spread = joined[order], mix(drawn[order])
    first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1])) if len(joined) else np.zeros(0, np.int64)
    sums = np.add.reduceat(spread, first) if len(first) else np.zeros(0, np.uint64)
    row = (joined[first] >> np.uint64(40)).astype(np.int64)
    place = joined[first] & np.uint64((1 << 40) - 1)
    number = np.arange(len(row)) - np.searchsorted(row, row)  # of the class among the row's own
    # the other set has 1.25 times as many shingles at most, or fewer if this one comes from the level above
    bound = np.where(sizes >= top, most_apart(sizes, sizes), (100 - LEAST) * sizes // LEAST)
    kept = number <= bound[row]
    keys = mix(sums[kept] + mix(place[kept] * np.uint64(64) + level[row[kept]].astype(np.uint64)) * np.uint64(BASE))
    thin = np.flatnonzero((np.bincount(row, minlength=len(sizes)) <= bound) & (sizes > 0))
    thin_keys = mix(level[thin].astype(np.uint64) + np.uint64(1 << 50))
    return np.append(keys, thin_keys), np.append(row[kept], thin)


def far_keys(elements: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all regions of the far sets in a batch."""
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    level = np.log2(np.maximum(sizes, 1)).astype(np.int64)  # exact below 2**48
    one = region_keys(elements, rows, sizes, level, common)
    # partners of the next lower power are at least LEAST percent as large
    lower = (level > 0) & (LEAST * sizes <= 100 * ((1 << level) - 1))
    again = lower[rows]
    number = np.cumsum(lower) - 1
    keys, own = region_keys(elements[again], number[rows[again]], sizes[lower], level[lower] - 1, common)
    return np.append(one[0], keys), np.append(one[1], np.flatnonzero(lower)[own])


def _batch_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets) of packed sets."""
    sets = [unpack(c.as_py() or b"") for c in batch.column("content")]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def sets_of(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """One row a document: ``row`` (a number of its own), doc_id, size, k1 and k2 (digest of the set), signature and
    content; the last two are null for an empty set."""
    prepare(docs.sparkSession)
    names = ["row", "doc_id", "size", "k1", "k2", "signature", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                elements, offsets = shingle_sets(part.column("text"), n)
                sets = [elements[s:e] for s, e in zip(offsets, offsets[1:])]
                packed = [pack(s) if len(s) else None for s in sets]
                digests = np.frombuffer(b"".join([hashlib.blake2b(p or b"", digest_size=16).digest() for p in packed]), "<i8").reshape(-1, 2)
                signed = [sketch(s) if len(s) else None for s in sets]
                cols = [part.column("row"), part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(signed, pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(trimmed(run), "row long, doc_id long, size long, k1 long, k2 long, signature binary, content binary")


def sample_of(sets: DataFrame) -> tuple[list[int], list[np.ndarray]]:
    """(k1, elements) of SAMPLE distinct sets at most, those with the smallest hashes of their digests."""
    chosen = sets.where("size > 0").groupBy("k1", "size").count().orderBy(F.xxhash64("k1"), "k1", "size").limit(SAMPLE).collect()
    total, ids = 0, []
    for r in chosen:
        if total + r["size"] <= SAMPLE_SHINGLES:
            total += r["size"]
            ids.append(r["k1"])
    found = {r["k1"]: unpack(r["content"]) for r in sets.where(F.col("k1").isin(ids)).groupBy("k1").agg(F.first("content").alias("content")).collect()} if ids else {}
    return list(found), list(found.values())


def region_rows(sets: DataFrame, pivots: Pivots) -> DataFrame:
    """(k1, pivot, distance) of every set in or near the region of a pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pivot, distance, _ = pivots.regions(*_batch_sets(batch))
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array(row)), pa.array(pivot), pa.array(distance)], names=["k1", "pivot", "distance"])

    return sets.where("size > 0").select("k1", "content").mapInArrow(trimmed(run), "k1 long, pivot long, distance double")


def far_regions(sets: DataFrame, pivots: Pivots, common: np.ndarray) -> DataFrame:
    """(key, k1) of the regions that hold more than one distinct set beyond all pivots.

    Keys travel in blocks of one part each, and a part is compared in one task: at most about PART_KEYS
    keys, as their number follows from the shingles in all. Equal sets count once, so that a part
    holds an equal key for each distinct set only."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), int(total // (3 * PART_KEYS)) + 1)

    def pack_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, offsets = _batch_sets(batch)
            ids = np.array(batch.column("k1"))
            nearest = pivots.regions(elements, offsets)[3]
            far = np.flatnonzero(nearest > RADIUS + SLACK)
            far = far[np.unique(ids[far], return_index=True)[1]]
            sizes = np.diff(offsets)[far]
            inside = np.repeat(offsets[:-1][far], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys, rows = far_keys(elements[inside], np.append(0, np.cumsum(sizes)), common)
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, owners, part = keys[order], ids[far][rows[order]], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            blocks = [(int(p[0]), k.tobytes(), o.tobytes()) for p, k, o in zip(np.split(part, cuts), np.split(keys, cuts), np.split(owners, cuts)) if len(p)]
            cols = list(zip(*blocks)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["part", "keys", "ids"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys += [np.frombuffer(b.as_py(), np.uint64) for b in batch.column("keys")]
            ids += [np.frombuffer(b.as_py(), np.int64) for b in batch.column("ids")]
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        met = np.zeros(len(keys), bool)
        met[1:] = keys[1:] == keys[:-1]
        met[:-1] |= met[1:]
        keys, ids = keys[met], ids[met]
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        several = np.zeros(len(keys), bool)
        several[1:] = keys[1:] == keys[:-1]
        several[:-1] |= several[1:]
        keys, ids = keys[several].view(np.int64), ids[several]
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(ids[i : i + (1 << 16)])], names=["key", "k1"])

    blocks = sets.where("size > 0").select("k1", "content").mapInArrow(trimmed(pack_keys), "part int, keys binary, ids binary")
    return blocks.repartitionById(parts, F.col("part")).mapInArrow(trimmed(repeated), "key long, k1 long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text).

    A document is the set of its distinct shingles of SHINGLE words (A to Z in lower case, parted at ASCII white
    space), with fewer words the whole sequence as one. Two are linked if they share at least LEAST
    percent of the union; ``component_id`` is the smallest doc_id that links reach. Null, empty and blank
    texts have no shingles and are components of their own. Repeated doc_ids are rows of their own, and a
    null doc_id gives way to any other; a component of nulls only has a null id. Other columns don't
    matter. An empty table gives no rows."""
    sets = saved_by(sets_of(docs), "shingle-sets", "row")
    firsts = saved(sets.where("size > 0").groupBy("k1", "k2").agg(F.min("row").alias("row")), "distinct-sets")
    names, sampled = sample_of(sets)
    counted = np.unique(np.concatenate([*sampled, np.zeros(0, np.uint64)]).astype(np.uint64), return_counts=True)
    chosen = thinned(sampled)
    pivots = Pivots([sampled[i] for i in chosen])

    regions = saved(region_rows(sets, pivots).distinct(), "voronoi-regions")
    pivot_rows = docs.sparkSession.createDataFrame([(i, names[c]) for i, c in enumerate(chosen)], "pivot long, pivot_k1 long")  # SAMPLE rows at most
    row_of = firsts.select("k1", "row")
    near = regions.where(F.col("distance") <= EPS + SLACK).join(F.broadcast(pivot_rows), "pivot").join(row_of, "k1")
    near = near.join(row_of.select(F.col("k1").alias("pivot_k1"), F.col("row").alias("pivot_row")), "pivot_k1")
    known = near.where("row <> pivot_row").select(F.greatest("row", "pivot_row").alias("a"), F.least("row", "pivot_row").alias("b"))
    known = saved(known.distinct(), "pivot-links")

    far = saved(far_regions(sets, pivots, counted[0][counted[1] >= COMMON]), "far-regions")
    keyed = regions.select(F.xxhash64(F.lit("pivot"), "pivot").alias("key"), "k1").unionByName(far)
    keys = keyed.join(row_of, "k1").select("key", "row")
    kept = sets.select("row", "signature", "content")
    labels = linked_labels(keys, kept, agreement, alike, known=known, screen=True)

    # every document takes the label of the first with its set; an empty one stands alone
    members = sets.select("row", "doc_id", "size", "k1", "k2").join(firsts.withColumnRenamed("row", "first"), ["k1", "k2"], "left")
    members = members.select("doc_id", "size", F.coalesce("first", "row").alias("first")).join(labels, F.col("first") == F.col("node"), "left")
    members = saved(members.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("label", "first").alias("label")), "jaccard-members")
    least = saved(members.groupBy("label").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return members.join(least, "label").select("doc_id", "n_shingles", "component_id")
