"""Stupid-backoff language model scores of all documents, from counts of all documents.

The score of a word is its relative frequency after the longest seen context, times 0.4 for each word
by which the context was cut. Counts leave out the document that is scored, so that a text doesn't
prove itself: an n-gram that occurs nowhere else backs off.

Relationally these are joins of the exploded n-grams with count tables partitioned by hash. Rows here
are packed: documents form blocks of bounded size, a block's distinct n-grams go to the partitions of
their hashes as sorted arrays with counts (the pre-aggregation), a partition adds up the counts of
all its blocks and answers each of them with totals in the same order, and a block sums its documents'
scores. A hash partition gets at most one entry of an n-gram from a block, so no frequent n-gram
makes a partition large, and the number of partitions follows the number of words. Blocks are stored
in buckets, so only the answers move to them. Hashes have 24 bits more than the number of n-grams
needs, at least 52: an n-gram shares its hash with another one with a probability below 2**-24.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved_by, slices
from .words import ngrams, word_hashes

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8 << 20  # text of a block; a longer document is a block of its own
PART_ENTRIES = 3_000_000  # entries of a hash partition, about


def _blocks(order: int):
    """Documents to blocks: (block, words, docs); ``docs`` is a compressed Arrow table of doc_id and text."""
    schema = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("docs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, first = 0, None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            words = int(word_hashes(t["text"])[1][-1])
            sink = pa.BufferOutputStream()
            bare = t.select(["doc_id", "text"])
            with pa.ipc.new_stream(sink, bare.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(bare)
            row = [[first], [words], [sink.getvalue().to_pybytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES // 8):
                first = part.column("row")[0].as_py() if not held else first
                held.append(part)
                size += part.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _table(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all().combine_chunks()


def _grams(hashes: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    grams, gram_offsets = ngrams(hashes, offsets, n)
    return grams >> np.uint64(64 - bits), gram_offsets


def _distinct(hashes: np.ndarray, offsets: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of a block and their counts, for each order."""
    return [np.unique(_grams(hashes, offsets, n, bits)[0], return_counts=True) for n in range(1, order + 1)]


def _cuts(grams: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Places at which sorted hashes go over to the next of ``parts`` equal ranges."""
    edges = np.array([(i << bits) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the width comes first."""
    most = int(counts.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words and ``score`` of every document (doc_id, text): the mean natural logarithm of the
    stupid-backoff scores of its words, in lower case and parted at white space.

    A word that occurs in no other document counts as if it occurred once, at order one. Null, empty
    and blank texts have no words and a null score, as does every text of a corpus that has no other
    words. Repeated rows are documents of their own, so copies support each other. An empty table
    gives no rows."""
    prepare(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = saved_by(numbered.mapInArrow(_blocks(order), "block long, words long, docs binary"), "text-blocks", "block")
    total = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = max(1, total * order // PART_ENTRIES)
    bits = min(64, max(52, (total * order).bit_length() + 24))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs")):
                t = _table(docs.as_py())
                for n, (grams, counts) in enumerate(_distinct(*word_hashes(t["text"]), order, bits), 1):
                    cuts = _cuts(grams, parts, bits)
                    used = np.flatnonzero(np.diff(cuts))
                    rows = [(int(p), n, block, _deltas(grams[cuts[p] : cuts[p + 1]]), _narrow(counts[cuts[p] : cuts[p + 1]])) for p in used]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    def answer(t: pa.Table) -> pa.Table:
        """Totals of an n-gram over all blocks, for each block in its own order."""
        parts = [_undeltas(g) for g in t["grams"].to_pylist()]
        counts = [_wide(c) for c in t["counts"].to_pylist()]
        grams, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(grams)).astype(np.int64)
        found = totals[inverse]
        ends = np.cumsum([len(p) for p in parts])
        # less the block's own counts: mostly zero, so they take little room
        rest = [_narrow(found[e - len(p) : e] - c) for e, p, c in zip(ends, parts, counts)]
        return pa.table({"block": t["block"], "n": t["n"], "part": t["part"], "rest": pa.array(rest, pa.binary())})

    asked = blocks.select("block", "docs").mapInArrow(explode, "part int, n int, block long, grams binary, counts binary")
    answers = asked.groupBy("n", "part").applyInArrow(answer, "block long, n int, part int, rest binary")

    def score(texts: pa.Table, rest: pa.Table) -> pa.Table:
        out = []
        answered = {(n, p): r for n, p, r in zip(rest["n"].to_pylist(), rest["part"].to_pylist(), rest["rest"].to_pylist())}
        for docs in texts["docs"].to_pylist():
            t = _table(docs)
            hashes, offsets = word_hashes(t["text"])
            found = []
            for n, (grams, counts) in enumerate(_distinct(hashes, offsets, order, bits), 1):
                cuts = _cuts(grams, parts, bits)
                others = [_wide(answered[n, int(p)]) for p in np.flatnonzero(np.diff(cuts))]
                found.append((grams, counts + (np.concatenate(others) if others else np.zeros(0, np.int64))))
            out.append(pa.table({"doc_id": t["doc_id"], "n_words": pa.array(np.diff(offsets)), "score": pa.array(_scores(hashes, offsets, found, total, alpha, bits), pa.float64())}))
        return pa.concat_tables(out)

    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, score double")


def _scores(hashes: np.ndarray, offsets: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], total: int, alpha: float, bits: int) -> list[float | None]:
    """Mean log scores; ``found`` has the sorted n-grams of the block and their counts in the corpus."""
    order = len(found)
    words = np.diff(offsets)
    doc = np.repeat(np.arange(len(words)), words)
    rest = []  # for each order: occurrences in other documents of the n-gram that ends at each word
    for n, (grams, counts) in enumerate(found, 1):
        own, own_offsets = _grams(hashes, offsets, n, bits)
        docs = np.repeat(np.arange(len(words)), np.diff(own_offsets))
        at = np.searchsorted(grams, own)
        # the document's own occurrences
        order_by = np.lexsort((at, docs))
        key = np.stack([docs[order_by], at[order_by]])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)) if len(own) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        times = np.empty(len(own), np.int64)
        times[order_by] = np.bincount(group)[group] if len(own) else 0
        full = np.zeros(len(hashes), np.int64)
        inside = np.arange(len(hashes)) - offsets[doc] >= n - 1
        full[inside] = counts[at] - times
        rest.append(full)
    others = total - words[doc]
    score = np.log(np.maximum(rest[0], 1) / np.maximum(others, 1)) + (order - 1) * np.log(alpha)
    for n in range(2, order + 1):
        seen = rest[n - 1] > 0
        context = np.append(0, rest[n - 2][:-1])  # the context ends one word before
        score[seen] = np.log(rest[n - 1][seen] / context[seen]) + (order - n) * np.log(alpha)
    sums = np.bincount(doc, weights=score, minlength=len(words))
    return [float(s / n) if n and total > n else None for s, n in zip(sums, words)]


def _deltas(grams: np.ndarray) -> bytes:
    """Ascending hashes as differences, in as few bytes each as the largest needs; the first one whole."""
    steps = np.diff(grams, prepend=grams[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + grams[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _undeltas(packed: bytes) -> np.ndarray:
    width = packed[0]
    steps = np.zeros(((len(packed) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64) + np.frombuffer(packed[1:9], np.uint64)[0]
