"""WARC archives, and their capture index by an external merge of sorted runs.

Captures become WARC records, one gzip member a record; a payload that another capture holds in full is
a revisit record without payload. Spark's text writer puts the members out as they are: every member
ends with a zero byte (the top byte of its length), which the writer adds as its line separator, so
the files are plain ``.warc.gz`` on any file system.

Reading an archive yields its index entries as a run, sorted by URL key, timestamp and page. A fixed
number of sampled keys cuts the key space into ranges; every run is cut at them, and the slices of a
range meet in one task, which merges them by a tournament of losers. Nothing is sorted again, and a
URL that a third of all captures share is cut by timestamp and page as well.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import work_dir

from .common import prepare, saved, shuffle_partitions

ARCHIVE_BYTES = 32 << 20  # payload bytes of an archive, on average
RUN_ENTRIES = 50_000  # an archive of more records gives several runs
WINDOW = 1 << 13  # bytes of an archive that are unpacked at a time
REVISIT_BYTES = 1000  # smaller payloads are never replaced
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()),
    ("place", pa.int64()), ("size", pa.int64()),
])
ENTRY_SQL = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long, size long"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: ``org,example)/es/?a=b``. Empty without ``://``."""
    if url is None or "://" not in url:
        return ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    end = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def record(page_id: int | None, url: str | None, captured: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as gzip members; the last byte is always zero."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if captured is not None:
        head.append(f"WARC-Date: {captured}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    out = gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)
    return out if out[-1] == 0 else out + EMPTY_MEMBER


class Capture(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    place: int
    size: int


def captures(content: bytes) -> Iterator[Capture]:
    """Records of an archive, one gzip member at a time; empty members belong to the record before.

    The archive is read in windows: what a window holds beyond the end of its member is bounded, so the time
    is in proportion to the bytes."""
    place = 0
    view = memoryview(content)
    while place < len(content):
        unzip, parts, at = zlib.decompressobj(31), [], place
        while not unzip.eof:
            if at >= len(content):
                raise ValueError("archive is cut off")
            parts.append(unzip.decompress(view[at : at + WINDOW]))
            at = min(at + WINDOW, len(content))
        whole = b"".join(parts)
        size = at - place - len(unzip.unused_data)
        if whole:
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            length = int(headers["Content-Length"])
            if len(rest) != length + 4:
                raise ValueError("record length differs from its header")
            yield Capture(headers, rest[:length], place, size)
        place += size


def _page(urn: str | None) -> int | None:
    return None if urn is None else int(urn.removeprefix("<urn:page:").removesuffix(">"))


def entry(archive: str, c: Capture) -> tuple:
    h = c.headers
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and hashlib.sha1(c.payload).hexdigest() != digest:
        raise ValueError("payload differs from its digest")
    return (
        url_key(h.get("WARC-Target-URI")), h.get("WARC-Date"), _page(h.get("WARC-Record-ID")), int(h["X-Payload-Length"]), digest,
        h["WARC-Type"], _page(h.get("WARC-Refers-To")), archive, c.place, c.size,
    )


def sort_key(e: tuple) -> tuple:
    """URL key, timestamp, page; null first. Places tell repeated captures apart."""
    return e[0], e[1] or "", -(2**63) if e[2] is None else e[2], e[7], e[8]


class LoserTree:
    """k-way merge of sorted iterators: an inner node keeps the loser of its match, the winner goes up.
    Every step replays only the path of the last winner."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key = sources, key
        self.k = max(1, len(sources))
        self.items = [next(s, None) for s in sources] or [None]
        self.keys = [None if x is None else key(x) for x in self.items]
        self.losers = [0] * self.k
        winners = [0] * (2 * self.k)
        for i in range(2 * self.k - 1, 0, -1):
            if i >= self.k:
                winners[i] = i - self.k
            else:
                a, b = winners[2 * i], winners[2 * i + 1]
                winners[i], self.losers[i] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while self.items[self.winner] is not None:
            won = self.winner
            yield self.items[won]
            self.items[won] = fresh = next(self.sources[won], None)
            self.keys[won] = None if fresh is None else self.key(fresh)
            node = (won + self.k) // 2
            while node:
                if self._before(self.losers[node], won):
                    won, self.losers[node] = self.losers[node], won
                node //= 2
            self.winner = won


def _ipc(rows: list[tuple]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ENTRY.types)], schema=ENTRY)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ENTRY, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _entries(packed: bytes) -> list[tuple]:
    t = pa.ipc.open_stream(packed).read_all()
    return list(zip(*[c.to_pylist() for c in t.columns]))


def write_archives(pages: DataFrame) -> str:
    """Write the captures (page_id, url, html, captured) as WARC archives and return their folder.

    A null html is an empty payload. Of equal payloads of at least REVISIT_BYTES bytes the one with the
    largest page_id is a response and the others revisit it; rows that share this page_id are responses
    too, and so are all where every page_id is null. Null columns are left out of the record."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), payload.alias("payload"))
    # the hash for equality apart from the SHA-1 of the archive
    rows = rows.withColumn("same", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    large = rows.where(F.col("bytes") >= REVISIT_BYTES)
    groups = large.groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = saved(groups, "payload-groups")
    total = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    copies = groups.where("n > 1").select("same", "kept")
    joined = rows.join(copies, "same", "left")
    refers = F.when((F.col("bytes") >= REVISIT_BYTES) & (F.col("kept") != F.coalesce("page_id", F.col("kept") - 1)), F.col("kept"))
    chosen = joined.select("page_id", "url", "captured", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, captured, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                digest = hashlib.sha1(payload).hexdigest()
                out.append(record(page_id, url, captured, payload, digest, refers_to)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    per_file = max(1, ARCHIVE_BYTES * (total["n"] or 1) // max(1, total["b"] or 1))
    folder = work_dir(spark, "warc")
    members = chosen.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)
    return folder


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, samples, packed) of the archives: entries sorted within each run."""
    schema = pa.schema([("run", pa.string()), ("samples", pa.list_(pa.string())), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(archive: str, number: int, rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=sort_key)
            samples = [_bound(sort_key(r)) for r in rows[:: max(1, len(rows) // 20)]]
            row = [[f"{archive}:{number:06}"], [samples], [_ipc(rows)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                archive, number, rows = path.rsplit("/", 1)[-1], 0, []
                for c in captures(content.as_py()):
                    rows.append(entry(archive, c))
                    if len(rows) == RUN_ENTRIES:
                        yield flush(archive, number, rows)
                        number, rows = number + 1, []
                if rows:
                    yield flush(archive, number, rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, "run string, samples array<string>, packed binary")


def _bound(key: tuple) -> str:
    """A sort key as text of the same order (the parts have no control characters)."""
    return "\x01".join([key[0], key[1], f"{key[2] + 2**63:020}"])


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries of sorted runs in global order: ``position`` from 0, ``capture_no`` from 1 within the
    history of a URL key, and the entry's columns. ``runs`` should be a stored table."""
    spark = runs.sparkSession
    parts = shuffle_partitions(spark)
    samples = runs.select(F.explode("samples").alias("s"), "run")
    # a fixed number of samples, whatever the number of runs
    found = sorted(r["s"] for r in samples.orderBy(F.xxhash64("s", "run")).limit(20 * parts).collect())
    step = max(1, len(found) // parts)
    bounds = found[step::step][: parts - 1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, packed in zip(batch.column("run").to_pylist(), batch.column("packed")):
                rows = _entries(packed.as_py())
                keys = [_bound(sort_key(r)) for r in rows]
                cuts = [0, *[bisect_left(keys, b) for b in bounds], len(rows)]
                out = [(i, run, _ipc(rows[s:e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.binary()))], names=["bucket", "run", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(bucket: int, slices: list[bytes]) -> Iterator[pa.RecordBatch]:
            out, last, number, place = [], None, 0, 0
            for e in LoserTree([iter(_entries(s)) for s in slices], sort_key):
                number = number + 1 if e[0] == last else 1
                last = e[0]
                out.append((bucket, place, number, *e))
                place += 1
                if len(out) == 10_000:
                    yield as_batch(out)
                    out = []
            if out:
                yield as_batch(out)

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int64(), *ENTRY.types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "place_in", "number", *ENTRY.names])

        now, slices = None, []
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if bucket != now and slices:
                    yield from flush(now, slices)
                    slices = []
                now = bucket
                slices.append(packed.as_py())
        if slices:
            yield from flush(now, slices)

    slices = runs.select("run", "packed").mapInArrow(cut, "bucket int, run string, packed binary")
    near = slices.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "run").select("bucket", "packed")
    merged = saved(near.mapInArrow(merge, f"bucket int, place_in long, number long, {ENTRY_SQL}"), "merged-index")

    # one row a range: where its positions begin, and the URL key whose history it goes on with
    ends = merged.groupBy("bucket").agg(F.count("*").alias("n"), F.min("url_key").alias("first"), F.max("url_key").alias("last"))
    tails = merged.groupBy("bucket", "url_key").agg(F.max("number").alias("number"))
    ends = ends.join(tails.withColumnRenamed("url_key", "last"), ["bucket", "last"]).orderBy("bucket").collect()
    carry, before, key, held = [], 0, None, 0
    for r in ends:
        goes_on = r["first"] == key
        carry.append((r["bucket"], before, key if goes_on else None, held if goes_on else 0))
        held = r["number"] + (held if goes_on and r["last"] == r["first"] else 0)
        before, key = before + r["n"], r["last"]
    carried = spark.createDataFrame(carry, "bucket int, _before long, _key string, _held long")
    joined = merged.join(F.broadcast(carried), "bucket")
    number = F.col("number") + F.when(F.col("url_key") == F.col("_key"), F.col("_held")).otherwise(0)
    return joined.select((F.col("_before") + F.col("place_in")).alias("position"), number.alias("capture_no"), *ENTRY.names)


def capture_index(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html, captured: timestamp) and their merged index: the
    captures in the order of URL key, timestamp and page. An empty table gives no rows."""
    prepare(pages.sparkSession)
    folder = write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "captured"))
    return merge_runs(saved(sorted_runs(pages.sparkSession, folder), "capture-runs"))
