"""Periodic runs of words, by seeds on diagonals that are extended once.

A run is a stretch of consecutive words with smallest period q that is at least ``REPEATS`` periods and
``SHORTEST`` words long and that no neighbouring word extends. On the diagonal of lag q (each word beside
the one q places on) a run is a stretch of matches of at least ``REPEATS - 1`` periods, the overlap that
is guaranteed. So for periods lo..hi every run holds equal k-grams at lag q for each k up to (REPEATS - 1) * lo.

Scales of periods share a length k with 2 * hi - 1 <= k <= (REPEATS - 1) * lo, the longest that the smallest period
guarantees. Then successive occurrences of a k-gram are enough: were the k-gram of a run with smallest
period q met again after fewer than q words, both would be periods of a stretch of at least q + q' words,
their common divisor too, and q not the smallest. So n words give at most n pairs a scale, whatever the
text, and the lag of such a pair is the smallest period of what it extends to.

A table holds for each lag how far it is covered: seeds come in ascending order, and one that lies
within the covered part has been extended already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, trimmed
from .words import BASE, SPACED, mix, word_hashes

REPEATS = 4
SHORTEST = 6
STRIDE = 64  # words compared at once when a seed is extended; doubled as long as all match

Run = tuple[int, int, int]  # start, length, period


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, k): the periods lo..hi that a text of ``n`` words can hold, and their k."""
    lo = 1
    while max(REPEATS * lo, SHORTEST) <= n:
        k = max(REPEATS * lo, SHORTEST) - lo  # the overlap that the shortest run of period lo has with itself
        hi = (k + 1) // 2
        yield lo, hi, k
        lo = hi + 1


def _gram_hashes(sums: np.ndarray, inverse: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams from running sums of a polynomial in the words."""
    return mix((sums[k:] - sums[:-k]) * inverse[: len(sums) - k])


def seeds(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, lag, place in the text) of successive occurrences of an equal k-gram, in this order."""
    n = np.diff(offsets)
    found = []
    if len(words):
        powers = np.full(len(words), BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(len(words) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * powers, out=sums[1:])
    text_of = np.repeat(np.arange(len(n)), n)
    left = n[text_of] - (np.arange(len(words)) - offsets[:-1][text_of])  # words from here to the end of the text
    for lo, hi, k in scales(int(n.max(initial=0))):
        # a text holds the scale if it has room for the smallest of its runs
        at = np.flatnonzero((left >= k) & (n[text_of] >= max(REPEATS * lo, SHORTEST)))
        if not len(at):
            break
        keys = _gram_hashes(sums, inverse, k)[at] + mix(text_of[at].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        lag = at[1:] - at[:-1]
        good = (keys[1:] == keys[:-1]) & (lag >= lo) & (lag <= hi) & (text_of[at[1:]] == text_of[at[:-1]])
        i = at[:-1][good]
        found.append(np.stack([text_of[i], lag[good], i - offsets[:-1][text_of[i]]], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    seeds = np.concatenate(found)
    return seeds[np.lexsort((seeds[:, 2], seeds[:, 1], seeds[:, 0]))]


def _matches(one: np.ndarray, other: np.ndarray) -> int:
    """How many words agree from the beginning on, read in growing strides."""
    done, stride, n = 0, STRIDE, min(len(one), len(other))
    while done < n:
        upto = min(done + stride, n)
        apart = np.flatnonzero(one[done:upto] != other[done:upto])
        if len(apart):
            return done + int(apart[0])
        done, stride = upto, 2 * stride
    return n


def extend(words: np.ndarray, found: np.ndarray) -> list[Run]:
    """Runs of one text, by start and period, from its (lag, place) in ascending order."""
    covered: dict[int, int] = {}  # lag: end of the part that has been extended
    runs = []
    for lag, place in found.tolist():
        if place < covered.get(lag, 0):
            continue
        ahead = _matches(words[place:], words[place + lag :])
        back = _matches(words[:place][::-1], words[: place + lag][::-1])
        covered[lag] = place + ahead
        length = back + ahead + lag
        if length >= max(REPEATS * lag, SHORTEST):
            runs.append((place - back, length, lag))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, offsets: np.ndarray) -> dict[int, list[Run]]:
    """Runs of each text that has any, by its number. A seed that nothing covers is extended once."""
    found = seeds(words, offsets)
    cuts = np.flatnonzero(np.diff(found[:, 0])) + 1
    out = {}
    for part in np.split(found, cuts) if len(found) else []:
        text = int(part[0, 0])
        runs = extend(words[offsets[text] : offsets[text + 1]], part[:, 1:])
        if runs:
            out[text] = runs
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats after its first period, joined by one blank."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``runs`` (array of start, length, period; by start, then period) and
    ``collapsed``, the words that no run repeats. One pass, no shuffle; a text is whole in its task.

    Words are runs of bytes other than ASCII white space, case counts; they are told apart by 64-bit
    hashes within a text. Null and empty texts have no runs and collapse to an empty text. Repeated rows
    and all other columns stay as they are; columns named ``runs`` or ``collapsed`` are refused. An empty
    table gives no rows."""
    if clash := {"runs", "collapsed"} & set(docs.columns):
        raise ValueError(f"the table already has a column {min(clash)}")
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text)
                found = runs_of(*word_hashes(texts, lower=False, in_word=SPACED))
                collapsed = [
                    collapse(t.split(), found.get(i, [])).decode() if t else ""
                    for i, t in enumerate(texts.cast(pa.binary()).to_pylist())
                ]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, [])] for i in range(part.num_rows)]
                cols = [part.column(c) for c in others] + [pa.array(runs, pa.list_(run_type)), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*others, "runs", "collapsed"])

    schema = docs.select(*others).withColumns({
        "runs": F.lit(None).cast("array<struct<start: bigint, length: bigint, period: bigint>>"), "collapsed": F.lit(None).cast("string"),
    }).schema
    return docs.select(*others, text).mapInArrow(trimmed(run), schema)


def planted(text: Column, key: Column) -> Column:
    """The text as the query wants it: with h = crc32 of the decimal key, a tenth of the texts repeat
    p words from word a on to their end. The others stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    n = F.greatest(F.size(words), F.lit(1))
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.size(words) > 0), repeated).otherwise(text)
