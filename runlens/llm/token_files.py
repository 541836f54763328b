"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length code.

A file holds one chunk of whole documents in ascending doc_id order:

    magic "RLTK", version, then seven unsigned 64-bit numbers: number of documents, number of ids,
    place of the first id in the whole corpus, bytes of each of the four parts below
    1. doc_ids   signed 64-bit, the lowest number for null
    2. lengths   unsigned 64-bit, ids of each document
    3. control   two bits for each id, four ids a byte, lowest bits first: data bytes less one
    4. data      the id's frequency rank, little-endian, one to four bytes

Ranks are by corpus frequency (ties to the smaller id), so the 256 most frequent ids take one byte.
The table of ranks is a Parquet table of its own, as long as the vocabulary. Everything goes through
Spark's readers and writers, so any shared file system will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import work_dir

from .common import range_bounds, saved, shuffle_partitions, slices, trimmed
from .tokens import encoder

MAGIC = b"RLTK"
HEAD = struct.Struct("<4sI7Q")
CHUNK_IDS = 2_000_000  # a chunk ends at the first document end beyond so many ids
STRETCH = 1 << 14  # ids coded at a time, a multiple of four
NULL_ID = -(2**63)

#: Lengths of the four ids that a control byte describes.
LENGTHS = np.array([[(b >> s & 3) + 1 for s in (0, 2, 4, 6)] for b in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks, made stretch by stretch so that arrays stay in the cache."""
    parts = [_encode_stretch(ranks[i : i + STRETCH]) for i in range(0, len(ranks), STRETCH)]
    return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


def _encode_stretch(ranks: np.ndarray) -> tuple[bytes, bytes]:
    most = int(ranks.max())
    width = 2 if most < 1 << 16 else 4
    raw = ranks.astype(f"<u{width}", copy=False)
    extra = (raw >= 1 << 8).view(np.uint8)
    for bits in (16, 24):
        if most >= 1 << bits:
            extra = extra + (raw >= 1 << bits)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    used = np.ones((len(ranks), width), bool)
    for k in range(1, width):
        used[:, k] = extra >= k
    return control.tobytes(), raw.view(np.uint8)[used.reshape(-1)].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks, by one table look-up for each control byte."""
    codes, padded = np.frombuffer(control, np.uint8), np.frombuffer(data + b"\0\0\0", np.uint8)
    out, begin = np.empty(n, np.uint32), 0
    for i in range(0, n, STRETCH):
        count = min(STRETCH, n - i)
        sizes = LENGTHS[codes[i // 4 : (i + count + 3) // 4]].reshape(-1)[:count]
        ends = np.cumsum(sizes, dtype=np.int32)
        own = padded[begin : begin + int(ends[-1]) + 3]
        at = ends - sizes
        ranks = own[at].astype(np.uint32)
        for k in range(1, int(sizes.max())):
            ranks |= np.where(sizes > k, own[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
        out[i : i + count] = ranks
        begin += int(ends[-1])
    return out


def encode_chunk(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    control, data = encode_ranks(ranks)
    parts = [doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), control, data]
    return HEAD.pack(MAGIC, 1, len(doc_ids), len(ranks), start, *map(len, parts)) + b"".join(parts)


def decode_chunk(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc_ids, lengths, ranks, start); bytes after the chunk are ignored."""
    magic, version, n_docs, n_ids, start, *sizes = HEAD.unpack_from(content)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token file of version 1")
    parts, at = [], HEAD.size
    for size in sizes:
        parts.append(content[at : at + size])
        at += size
    if len(parts[3]) != sizes[3]:
        raise ValueError("token file is cut off")
    ranks = decode_ranks(parts[2], parts[3], n_ids)
    return np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i8"), ranks, start


def _packed(vocabulary: str, end_id: int, bounds: list[int]):
    """Texts to ids; the documents of one bucket (range of doc_ids between ``bounds``) in a slice become one packed row."""
    cuts = np.array(bounds, dtype=np.int64)
    schema = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [b + end for b in encode.batch(part.column("text").to_pylist())]
                docs = np.array(pa.compute.fill_null(part.column("doc_id").cast(pa.int64()), NULL_ID))
                buckets = np.searchsorted(cuts, docs, side="right")
                rows = []
                for bucket in np.unique(buckets):
                    own = np.flatnonzero(buckets == bucket)
                    sizes = np.array([len(ids[i]) // 4 for i in own])
                    flat = np.frombuffer(b"".join([ids[i] for i in own]), "<u4")
                    rows.append((int(bucket), int(docs[own].min()), pack(docs[own], sizes, flat)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def pack(docs: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Documents with their ids as one compressed block; ids below 65,536 take two bytes."""
    narrow = flat.dtype.itemsize == 2 or not len(flat) or int(flat.max()) < 1 << 16
    body = flat.astype("<u2" if narrow else "<u4", copy=False).tobytes()
    whole = docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + body
    return struct.pack("<?2Q", narrow, len(docs), len(whole)) + pa.compress(whole, "zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids)"""
    narrow, n, size = struct.unpack_from("<?2Q", packed)
    body = pa.decompress(memoryview(packed)[17:], size, "zstd", asbytes=True)
    docs, sizes = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i8", n, 8 * n)
    return docs, sizes, np.frombuffer(body, "<u2" if narrow else "<u4", -1, 16 * n)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of a bucket to chunks of documents in order.

    A partition holds whole buckets; one bucket is a bounded share of the corpus and is gathered."""
    schema = pa.schema([("bucket", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("packed", pa.binary()), ("counts", pa.binary())])

    def flush(bucket: int, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs, sizes, flats = zip(*map(unpack, rows))
        begins = np.concatenate([np.cumsum(s) - s for s in sizes])
        block = np.repeat(np.arange(len(rows)), [len(d) for d in docs])
        docs, sizes = np.concatenate(docs), np.concatenate(sizes)
        # equal doc_ids in the order of their ids, so that a repeated run gives the same files
        order = np.argsort(docs, kind="stable")
        for tie in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1) if len(np.unique(docs)) < len(docs) else []:
            if len(tie) > 1:
                where = np.searchsorted(docs[order], docs[tie[0]])
                order[where : where + len(tie)] = sorted(tie, key=lambda i: flats[block[i]][begins[i] : begins[i] + sizes[i]].tolist())
        start, own, total = 0, [], 0
        for i in order:
            own.append(i)
            total += int(sizes[i])
            if total >= CHUNK_IDS:
                yield chunk(bucket, start, own, docs, sizes, flats, block, begins)
                start, own, total = start + total, [], 0
        if own:
            yield chunk(bucket, start, own, docs, sizes, flats, block, begins)

    def chunk(bucket, start, own, docs, sizes, flats, block, begins) -> pa.RecordBatch:
        flat = np.concatenate([flats[block[i]][begins[i] : begins[i] + sizes[i]] for i in own])
        counts = np.bincount(flat)
        found = np.flatnonzero(counts)
        row = [[bucket], [start], [len(flat)], [pack(docs[own], sizes[own], flat)], [np.stack([found, counts[found]]).astype("<i8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

    now, rows = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
            if bucket != now and rows:
                yield from flush(now, rows)
                rows = []
            now = bucket
            rows.append(packed)
    if rows:
        yield from flush(now, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks' counts of ids: at most one row for each id and task."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for packed in batch.column("counts"):
            ids, own = np.frombuffer(packed.as_py(), "<i8").reshape(2, -1)
            if len(ids) and ids[-1] >= len(counts):
                counts = np.append(counts, np.zeros(ids[-1] + 1 - len(counts), np.int64))
            counts[ids] += own
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 0) -> tuple[str, str]:
    """Write token files of all ``docs`` (doc_id, text) and their table of ranks: (folder, table path).

    Null texts are empty, every document ends with ``end_id``, repeated doc_ids stay separate
    documents in the order of their ids, a null doc_id comes first. An empty table gives no file.
    One shuffle of packed ids brings each range of doc_ids into one task; counts, places and files
    are made from the saved chunks without another.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(spark)
    bounds = range_bounds(docs, "doc_id", parts)
    rows = docs.mapInArrow(trimmed(_packed(vocabulary, end_id, bounds)), "bucket int, first long, packed binary")
    rows = rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "first")
    chunks = saved(rows.mapInArrow(trimmed(_chunks), "bucket int, start long, n_ids long, packed binary, counts binary"), "token-chunks")

    counts = chunks.select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the vocabulary at most
    found = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))
    ranked = np.array([r["id"] for r in found], dtype=np.int64)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    # as many rows as ranges
    totals = dict(chunks.groupBy("bucket").agg(F.sum("n_ids")).collect())
    before, total = {}, 0
    for bucket in sorted(totals):
        before[bucket] = total
        total += totals[bucket]

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lengths, ids = unpack(row["packed"])
                content = encode_chunk(doc_ids, lengths, rank_of[ids], before[row["bucket"]] + row["start"])
                yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

    folder, ranks = work_dir(spark, "token-files"), work_dir(spark, "token-ranks")
    # the text writer puts out the bytes as they are; one chunk a file
    files_out = chunks.drop("counts").mapInArrow(trimmed(files), "content binary").select(F.col("content").cast("string").alias("value"))
    files_out.write.option("maxRecordsPerFile", 1).text(folder)
    table = pa.table({"rank": np.arange(len(ranked), dtype=np.int64), "id": ranked})
    spark.createDataFrame(table).coalesce(1).write.parquet(ranks)
    return folder, ranks


def read_tokens(spark, folder: str, ranks: str, digest: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, and their ``ids`` (array of int), or with
    ``digest`` only ``ids_crc32``, the unsigned crc32 of the ids as little-endian 32-bit numbers."""
    pairs = spark.read.parquet(ranks).collect()  # as long as the vocabulary
    id_of = np.zeros(max(len(pairs), 1), dtype="<u4")
    for row in pairs:
        id_of[row["rank"]] = row["id"]
    kind = pa.int64() if digest else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                docs, lengths, found, start = decode_chunk(content.as_py())
                ids = id_of[found]
                ends = np.cumsum(lengths)
                if digest:
                    last = pa.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths)], kind)
                else:
                    last = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids.astype(np.int32)))
                doc_ids = pa.array(docs, pa.int64(), mask=docs == NULL_ID)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - lengths), pa.array(lengths), last], names=["doc_id", "start", "n_tokens", "last"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    last = "ids_crc32 long" if digest else "ids array<int>"
    name = last.split()[0]
    return files.mapInArrow(trimmed(run), f"doc_id long, start long, n_tokens long, last {last.split()[1]}").withColumnRenamed("last", name)
