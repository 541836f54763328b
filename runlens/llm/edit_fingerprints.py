"""Fingerprints of whole texts by randomised edit embedding.

All texts share a few independent random walks: at step ``j`` of a walk a character either stays or gives
way to the next one, as a random bit of (walk, j, character) says. The text as a walk sees it, step by
step, is its embedding: texts a small edit distance apart differ in few steps, because their walks fall
into step again after an edit. How soon is a matter of luck, so each walk is judged on its own and the one
that agrees best counts. A fingerprint samples steps of the embeddings, so edit distance becomes the
Hamming distance of short strings.

Steps are sampled for two scales of length, the power of two at or above the text's own length and the
next one, so that texts up to about twice as long share a scale. A sample is one hexadecimal digit: 0
where the text has ended, else 1 to 15, a hash of the slot and the character.

    fingerprint = scale (2 hexadecimal digits), SLOTS digits of that scale, SLOTS digits of the next;
    walk w has the w-th SLOTS / WALKS digits of each scale
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .banding import linked_labels, named_classes
from .common import bucket_of, prepare, range_bounds, saved, shuffle_partitions, slices, trimmed
from .words import mix

SLOTS = 256
WALKS = 4  # independent walks, each with an equal share of the slots
CLASSES = 64  # the walks' bits are drawn for so many classes of characters
PERIOD = 1 << 16  # and repeat after so many steps
STRETCH = 256  # characters of every text walked at a time
SIDE_BY_SIDE = 2 << 20  # about so many bytes of text at most
FEW = 4  # fewer texts are walked one by one
APART = 1 << 40  # more than the steps of any text
SEED = 20240229
LIKENESS = 0.6  # least likeness of a link, by the walk that agrees best
SAMPLED, BAND_STEP = 8, 4  # samples of a band, and how many further on the next band of the walk begins


def _draw(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + salt))


def _stays(walks: int) -> np.ndarray:
    """For each class, walk and step: the number of steps until the character gives way. The first steps
    follow the last ones once more, as far as a stretch can reach."""
    out = np.empty((CLASSES, walks, PERIOD), np.uint8)
    at = np.arange(2 * PERIOD)
    for c in range(CLASSES):
        drawn = _draw(PERIOD, c + 1)
        for k in range(walks):
            gives = np.tile((drawn >> np.uint64(k)) & np.uint64(1), 2).astype(bool)
            nearest = np.minimum.accumulate(np.where(gives, at, 2 * PERIOD)[::-1])[::-1]
            out[c, k] = (nearest - at + 1)[:PERIOD]
    return np.concatenate([out, out[:, :, : STRETCH * int(out.max())]], axis=2)


class Walker:
    """The shared walks, their samples and the samples' digits."""

    def __init__(self, walks: int = WALKS) -> None:
        self.walks, self.share = walks, SLOTS // walks
        stays = _stays(walks)
        self.width = stays.shape[2]
        self.stays = stays.ravel()
        self.rows = [[stays[c, k].tobytes() for c in range(CLASSES)] for k in range(walks)]
        self.class_of = (mix(np.arange(0x110000, dtype=np.uint64)) >> np.uint64(58)).astype(np.uint8)
        drawn = (_draw(SLOTS, 1000) >> np.uint64(11)).astype(np.float64) / 2.0**53
        self.places = (np.arange(SLOTS) % self.share + drawn) / self.share  # one in each part of the walk
        self.salts = np.tile(_draw(SLOTS, 2000), 2)
        self.sampled: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def moves(self, texts: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        """(walk, character) for each text: the steps a walk spends on a character, from its start on.
        The texts go side by side, a character of each at a time."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        out = [np.empty((self.walks, n), np.uint8) for n in lengths]
        classes = self.class_of[np.concatenate([*texts, np.zeros(STRETCH, np.uint32)])]
        first = (np.cumsum(lengths) - lengths)[order]
        steps = np.array(starts, dtype=np.int64).reshape(len(texts), self.walks)[order]
        sorted_lengths = lengths[order]
        own = np.arange(self.walks) * self.width
        done, longest = 0, int(lengths.max(initial=0))
        while done < longest:
            m = int((sorted_lengths > done).sum())
            if m < FEW:
                break
            width = min(STRETCH, int(sorted_lengths[0]) - done)
            near = first[:m, None] + done + np.arange(width)
            offset = (classes[np.minimum(near, len(classes) - 1)].T.astype(np.int64) * (self.walks * self.width))[:, :, None]
            at = (steps[:m] & (PERIOD - 1)) + own
            before = at.copy()
            spent = np.empty((width, m, self.walks), np.uint8)
            for j in range(width):
                np.take(self.stays, at + offset[j], out=spent[j], mode="clip")
                at += spent[j]
            steps[:m] += at - before
            for r in range(m):
                out[order[r]][:, done : done + width] = spent[: sorted_lengths[r] - done, r].T
            done += width
        for r in range(int((sorted_lengths > done).sum())):
            seen, kept = classes[first[r] + done : first[r] + sorted_lengths[r]].tobytes(), out[order[r]][:, done:]
            for k, rows in enumerate(self.rows):
                step, spent = int(steps[r, k]), bytearray()
                add = spent.append
                for stay in map(rows.__getitem__, seen):
                    here = stay[step & (PERIOD - 1)]
                    add(here)
                    step += here
                kept[k] = np.frombuffer(spent, np.uint8)
        return out

    def reached(self, moves: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
        """(walk, character): steps at which a walk reaches each character, and the step after the last one."""
        out = np.zeros((self.walks, moves.shape[1] + 1), np.int64)
        np.cumsum(moves, axis=1, out=out[:, 1:])
        return out + np.asarray(start, dtype=np.int64).reshape(-1, 1)

    def walk(self, codes: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """``reached`` of one text."""
        starts = np.broadcast_to(np.asarray(start), (1, self.walks))
        return self.reached(self.moves([codes], starts)[0], starts[0])

    def samples(self, scale: int) -> tuple[np.ndarray, np.ndarray]:
        """The walks of a scale's and the next one's samples, and their steps with the walks one after another."""
        if scale not in self.sampled:
            steps = np.concatenate([(self.places * (2 << (scale + k))).astype(np.int64) for k in (0, 1)])
            walk_of = np.tile(np.arange(SLOTS) // self.share, 2)
            self.sampled[scale] = walk_of, steps + walk_of * APART
        return self.sampled[scale]

    def fingerprint(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> str:
        """Of consecutive stretches (codes, reached) of one text, walked from step 0 on."""
        codes, reached = parts[0]
        if len(parts) > 1:
            codes = np.concatenate([c for c, _ in parts])
            reached = np.concatenate([*(r[:, :-1] for _, r in parts), parts[-1][1][:, -1:]], axis=1)
        scale = max(len(codes) - 1, 0).bit_length()
        walk_of, steps = self.samples(scale)
        apart = (reached + np.arange(self.walks)[:, None] * APART).ravel()
        at = np.searchsorted(apart, steps, side="right") - 1 - walk_of * (len(codes) + 1)
        inside = np.flatnonzero(at < len(codes))
        found = np.zeros(2 * SLOTS, np.uint8)
        found[inside] = 1 + (mix(codes[at[inside]].astype(np.uint64) ^ self.salts[inside]) % np.uint64(15)).astype(np.uint8)
        return f"{scale:02x}" + (found + np.where(found < 10, 48, 87).astype(np.uint8)).tobytes().decode()

    def fingerprints(self, texts: list[np.ndarray]) -> list[str]:
        moves = self.moves(texts, np.zeros((len(texts), self.walks)))
        return [self.fingerprint([(c, self.reached(m))]) for c, m in zip(texts, moves)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def likeness(a: str, b: str, walks: int = WALKS) -> float:
    """Share of equal samples among those where either text goes on, less what chance gives, in the walk
    that agrees best; 0 where one text is less than about half as long as the other, 1 for two empty texts.

    Every second sample chooses the walk and the others judge it, and the other way round: the best of
    several counts on the same samples would be too high."""
    scales = int(a[:2], 16), int(b[:2], 16)
    scale = max(scales)
    if scale - min(scales) > 1:
        return 0.0
    x, y = (np.frombuffer(f[2 + SLOTS * (scale - s) :][:SLOTS].encode(), np.uint8) for f, s in ((a, scales[0]), (b, scales[1])))
    live = (x != 48) | (y != 48)
    if not live.any():
        return 1.0
    same, live = (np.reshape(v, (walks, -1, 2)).sum(axis=1) for v in ((x == y) & live, live))  # (walk, half)
    best = (same / np.maximum(live, 1)).argmax(axis=0)[::-1]
    share = float(same[best, (0, 1)].sum() / max(live[best, (0, 1)].sum(), 1))
    return max(0.0, (share - 1 / 15) / (1 - 1 / 15))


_WALKERS: list[Walker] = []


def walker() -> Walker:
    if not _WALKERS:
        _WALKERS.append(Walker())
    return _WALKERS[0]


def fingerprint(text: Column) -> Column:
    """Fingerprint of a whole text; null is empty."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(walker().fingerprints([code_points(t or "") for t in texts.to_pylist()]), pa.string())

    return run(text)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each bucket closed by a copy of the document after it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    w, waiting = walker(), None
    for whole in batches:
        for batch in slices(whole, "text", SIDE_BY_SIDE):
            out: list[tuple] = []
            pairs: list[tuple] = []
            ids, extras = batch.column("doc_id").to_pylist(), batch.column("extra").to_pylist()
            texts = [t.as_py() or "" for t in batch.column("text")]
            codes = [code_points(t) for t in texts]
            moves = w.moves(codes, np.zeros((len(codes), w.walks)))
            for row in zip(ids, extras, texts, codes, moves):
                if row[1] and waiting is None:
                    continue  # another row with the doc_id of the document after the bucket
                row = (*row, w.fingerprint([(row[3], w.reached(row[4]))]))
                if waiting is not None:
                    pairs.append((waiting, row))
                waiting = None if row[1] else row
            if pairs:
                kept = [b[4][:, : len(b[3]) - len(b[3]) // 2] for b, _ in pairs]
                taken = [a[3][: len(b[3]) // 2] for b, a in pairs]
                tails = w.moves(taken, np.array([k.sum(axis=1, dtype=np.int64) for k in kept]))
                for (b, a), head, tail, after in zip(pairs, kept, tails, taken):
                    before = b[3][: head.shape[1]]
                    edited = w.fingerprint([(np.concatenate([before, after]), w.reached(np.concatenate([head, tail], axis=1)))])
                    digest = hashlib.sha256((b[2][: len(before)] + a[2][: len(after)]).encode()).hexdigest()
                    out.append((b[0], len(b[3]), digest, b[5], edited, likeness(b[5], edited), likeness(b[5], a[5])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, schema.types)], schema=schema)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like they are.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the
    next document, in ascending doc_id (null first; equal ids by their texts); after the last comes the
    first. A null text is empty. A single document is its own next one. Repeated doc_ids are rows of
    their own but share a task. One shuffle brings each range of doc_ids into a task, and the first
    document of the next range is sent along, one a range."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(spark)
    least = -(2**63)
    ordered = F.coalesce("doc_id", F.lit(least))
    bounds = range_bounds(docs, "doc_id", parts)
    heads = docs.withColumn("bucket", bucket_of("doc_id", bounds)).groupBy("bucket").agg(F.min(ordered).alias("head")).collect()
    heads = sorted((r["bucket"], r["head"]) for r in heads)  # one row a range
    # the range that a head closes; the first closes the last
    closes = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    rows = docs.withColumn("bucket", bucket_of("doc_id", bounds))
    if closes:
        copies = spark.createDataFrame(list(closes.items()), "head long, closed int")
        rows = rows.join(F.broadcast(copies), ordered == F.col("head"), "left")
        targets = F.when(F.col("closed").isNull(), F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("extra")))).otherwise(
            F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("extra")), F.struct(F.col("closed").alias("to"), F.lit(1).alias("extra")))
        )
    else:
        targets = F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("extra")))
    spread = rows.select("doc_id", "text", F.explode(targets).alias("t")).select("t.to", "t.extra", "doc_id", "text")
    placed = spread.repartitionById(parts, F.col("to")).sortWithinPartitions("to", "extra", "doc_id", "text")
    return placed.select("doc_id", "extra", "text").mapInArrow(trimmed(_edits), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _windows() -> np.ndarray:
    """The slots of each band: consecutive samples of one walk, so that what a text and its copy share
    between two edits fills whole bands."""
    share = SLOTS // WALKS
    firsts = [k * share + i for k in range(WALKS) for i in range(0, share - SAMPLED + 1, BAND_STEP)]
    return np.array(firsts)[:, None] + np.arange(SAMPLED)


def _band_keys(prints: DataFrame) -> DataFrame:
    """(key, row): digits of each band, at both scales. A band that reaches beyond the end of the text has
    no key: the zeros there would be shared by all short texts of a scale."""
    slots = _windows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            row = np.array(batch.column("row"))
            for k in (0, 1):
                found = np.arange(1, len(slots) + 1, dtype=np.uint64)[None, :] * np.uint64(256) + (packed[:, :1] + np.uint64(k))
                digits = _digits(packed, k)[:, slots]
                for i in range(SAMPLED):
                    found = mix(found * np.uint64(0x9E3779B97F4A7C15) + digits[:, :, i].astype(np.uint64))
                live = (digits != 0).all(axis=2)
                yield pa.RecordBatch.from_arrays([pa.array(found[live].view(np.int64)), pa.array(np.repeat(row, live.sum(axis=1)), pa.int64())], names=["key", "row"])

    return prints.select("row", "fingerprint").mapInArrow(trimmed(run), "key long, row long")


def _digits(packed: np.ndarray, k: int) -> np.ndarray:
    """Digits of the own (0) or the next (1) scale of packed fingerprints, one a row."""
    half = packed[:, 1 + k * SLOTS // 2 : 1 + (k + 1) * SLOTS // 2]
    return np.stack([half >> 4, half & 15], axis=2).reshape(len(packed), SLOTS)


def likenesses(packed: np.ndarray, i: int, at: np.ndarray) -> np.ndarray:
    """``likeness`` of packed fingerprint ``i`` with those at the places."""
    scales = packed[:, 0].astype(int)
    out = np.zeros(len(at))
    for other in np.unique(scales[at]):
        mine = np.flatnonzero(scales[at] == other)
        scale = max(other, scales[i])
        if scale - min(other, scales[i]) > 1:
            continue
        x, y = _digits(packed[i : i + 1], scale - scales[i]), _digits(packed[at[mine]], scale - other)
        live = (x != 0) | (y != 0)
        same, count = (v.reshape(len(mine), WALKS, -1, 2).sum(axis=2) for v in ((x == y) & live, live))
        best = (same / np.maximum(count, 1)).argmax(axis=1)[:, None, ::-1]
        same, count = (np.take_along_axis(v, best, axis=1).sum(axis=(1, 2)) for v in (same, count))
        share = np.maximum(same / np.maximum(count, 1) - 1 / 15, 0.0) / (1 - 1 / 15)
        out[mine] = np.where(live.any(axis=1), share, 1.0)
    return out


def fingerprint_classes(prints: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``row``, doc_id, label, class_id, class_size of every row of ``prints`` (row, doc_id, fingerprint as
    bytes), a stored table.

    Fingerprints that share a band are verified as a whole; a likeness of at least ``least`` links them,
    and classes are the connected components. Equal fingerprints are one class."""
    marked = prints.select("row", "doc_id", F.unhex(F.md5("fingerprint")).alias("mark"))
    equal = saved(marked.groupBy("mark").agg(F.min("row").alias("first")), "equal-fingerprints")
    members = saved(marked.join(equal, "mark").select("row", "doc_id", "first"), "members")
    single = saved(prints.join(equal.select(F.col("first").alias("row")), "row", "left_semi").select("row", "fingerprint"), "single-fingerprints")
    unpacked: list = [None, None]

    def agreement(signed: list[bytes], i: int, at: np.ndarray) -> np.ndarray:
        if unpacked[0] is not signed:
            unpacked[:] = signed, np.frombuffer(b"".join(signed), np.uint8).reshape(len(signed), -1)
        return likenesses(unpacked[1], i, at) - least

    def alike(x: bytes, y: bytes) -> bool:
        return likeness(x.hex(), y.hex()) >= least

    kept = single.select("row", F.col("fingerprint").alias("signature"), F.col("fingerprint").alias("content"))
    return named_classes(members, linked_labels(_band_keys(single), kept, agreement, alike))


def edit_classes(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``fingerprint_classes`` of documents (doc_id, text); null and empty texts are one class."""
    prepare(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(fingerprint(F.col("text"))).alias("fingerprint"))
    return fingerprint_classes(saved(numbered, "fingerprints"), least)


def edits_and_classes(docs: DataFrame) -> DataFrame:
    """``edit_fingerprints`` of all documents with the class of each one among them all: class_id (the
    smallest doc_id, null if all are) and class_size."""
    digits = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    edits = edit_fingerprints(docs)
    columns = edits.columns
    # half as long in bytes as in digits
    edits = saved(edits.withColumns({c: F.unhex(c) for c in digits}).withColumn("row", F.monotonically_increasing_id()), "edits")
    classes = fingerprint_classes(edits.select("row", "doc_id", "fingerprint")).select("row", "class_id", "class_size")
    both = edits.join(classes, "row").withColumns({c: F.lower(F.hex(c)) for c in digits})
    return both.select(*columns, "class_id", "class_size")
