"""64-bit hashes of the words of many texts at once, with numpy over Arrow's own text buffer.

A word is a run of bytes above the blank (white space and control characters part words). Its hash is
a polynomial in its bytes modulo 2**64, taken from running sums, then mixed; equal words have equal
hashes anywhere. N-gram hashes are mixed from those of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19  # bytes hashed at a time; a longer word has a chunk of its own
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0][0]) < n:
        _TABLES[:] = [_powers(max(n, CHUNK + 4096))]
    return _TABLES[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Whether a byte belongs to a word: all above the blank, or all but the six bytes of ASCII white space.
PRINTED = np.arange(256) > 32
SPACED = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes with A to Z in lower case.
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(texts: pa.Array, lower: bool = True, in_word: np.ndarray = PRINTED, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): text i has words ``offsets[i]:offsets[i+1]``. Null has none.

    ``in_word`` tells which bytes make words, ``letters`` puts a byte for each byte (then without ``lower``)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower and letters is None:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if not n or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    first, last = int(bounds[0]), int(bounds[-1])
    solid = in_word[data[first:last]]
    if letters is not None:
        data, bounds = letters[data[first:last]], bounds - first
        first, last = 0, last - first
    edge = np.ones(last - first + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[bounds - first] = True
    cuts = np.flatnonzero(edge)  # runs of equal kind within a text
    starts, ends = cuts[:-1], cuts[1:]
    words = solid[starts]
    starts, ends = starts[words], ends[words]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        upto = max(int(np.searchsorted(ends, begin + CHUNK, side="right")), at + 1)
        stop = int(ends[upto - 1])
        powers, inverse = _tables(stop - begin + 1)
        sums = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum((data[first + begin : first + stop].astype(np.uint64) + np.uint64(1)) * powers[: stop - begin], out=sums[1:])
        s, e = starts[at:upto] - begin, ends[at:upto] - begin
        hashes[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = upto
    offsets = np.searchsorted(starts, bounds - first).astype(np.int64)
    return mix(hashes), offsets


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams within each text, offsets of the texts)."""
    total = len(hashes)
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    out = np.append(0, np.cumsum(counts))
    if total < n or not out[-1]:
        return np.zeros(0, np.uint64), out
    grams = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        grams = mix(grams * np.uint64(BASE) + hashes[k : total - n + 1 + k] + np.uint64(k + 1))
    ends = np.repeat(offsets[1:], np.diff(offsets))[: total - n + 1]
    return grams[np.arange(total - n + 1) + n <= ends], out
