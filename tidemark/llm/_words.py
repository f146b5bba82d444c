"""Vectorised words, hashes of words, rolling hashes of windows, and shingles of whole Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte
UTF-8 character. A word's hash adds a well-mixed value for each of its (byte, place). Windows of words have Rabin-Karp polynomials
modulo the prime 2**61 - 1 over those hashes. Both come from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64
_rng = np.random.default_rng(20240613)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
PRIME = (1 << 61) - 1
BASES = tuple(int(x) % PRIME for x in _rng.integers(2**60, 2**61, 4, dtype=np.uint64))
PLACE = U(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def modulo(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo PRIME."""
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 bits: 2**62 is 2, and 2**61 is 1."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return modulo(U(2) * (a1 * b1) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, U(pow(base, len(out), PRIME)))])
    return out[:n]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo PRIME for i < n; kept while not much larger than a chunk has words."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES // 4)
        have = power_table(base, size), power_table(pow(base, -1, PRIME), size)
        if size <= CHUNK_BYTES:
            _powers[base] = have
    return have


def sums_modulo(x: np.ndarray) -> np.ndarray:
    """Prefix sums modulo PRIME of numbers below it, with a 0 in front: halves are added apart, so that none overflows."""
    low, high = np.zeros(len(x) + 1, np.uint64), np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x & U((1 << 31) - 1), out=low[1:])
    np.cumsum(x >> U(31), out=high[1:])
    return modulo(times(modulo(high), U(1 << 31)) + modulo(low))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_parts(texts: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about chunk bytes; null is empty. A long text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + chunk, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in buf, runs of bytes that aren't outside, and for each row the index of its first word (one more entry at the end)."""
    word = ~outside[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = word
    before[offs] = False
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = word
    after[offs] = False
    starts = np.flatnonzero(word & ~before[:-1])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each of the disjoint ascending spans of bytes: the mixed sum of a value for each byte at its place in the span."""
    return prefix_hashes(buf, starts, ends, (), values)[0]


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], values: np.ndarray = BYTE_VALUES) -> list[np.ndarray]:
    """The spans' hashes, and for each size those of the first bytes of the spans that are longer, in their order."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    inside = buf[place + np.repeat(starts, lengths)]
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(values[inside] + place.astype(np.uint64) * PLACE), out=sums[1:])
    out = [mix(sums[before + lengths] - sums[before] + lengths.astype(np.uint64))]
    for k in sizes:
        at = before[lengths > k]
        out.append(mix(sums[at + k] - sums[at] + U((1 << 40) + k)))
    return out


def window_hashes(words: np.ndarray, size: int, base: int = BASES[1]) -> np.ndarray:
    """A rolling hash, below PRIME, of each run of size words, also of runs across rows: len(words) - size + 1 hashes."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    sums = sums_modulo(times(modulo(words), up[:n]))
    return times(modulo(sums[size:] + U(PRIME) - sums[: n - size + 1]), down[: n - size + 1])


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of the first word of every window of size words inside a row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, first[:-1][rows] + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and offsets by row.

    A row of fewer than size words, but some, has its whole sequence as one shingle; A-Z are taken as a-z.
    """
    starts, ends, first = word_spans(buf, offs)
    words = span_hashes(buf, starts, ends, LOWER_VALUES)
    counts = np.diff(first)
    rows, at = window_starts(first, size)
    full = window_hashes(words, size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.array([hash_sequence(words[first[r] : first[r + 1]]) for r in short], np.uint64)
        rows, full = np.concatenate([rows, short]), np.concatenate([full, own])
    order = np.lexsort((full, rows))
    rows, full = rows[order], full[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (full[1:] != full[:-1])
        rows, full = rows[new], full[new]
    return full, np.searchsorted(rows, np.arange(len(counts) + 1))


def hash_sequence(words: np.ndarray) -> int:
    """A hash of a whole sequence of words, above those of windows."""
    up, _ = powers(BASES[2], len(words) + 1)
    return int(sums_modulo(times(modulo(words), up[: len(words)]))[-1]) | (1 << 61)
