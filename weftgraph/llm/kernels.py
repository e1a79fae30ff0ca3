"""Vectorised text kernels: words, word hashes, word n-grams and sorted-set coding.

A *chunk* is a list of documents laid end to end in one byte array with an offset table, the
layout of an Arrow string column. All kernels work on a chunk at a time and never look across
a document's border.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: The white space of the words `[^\x20\x09-\x0D]+`.
WHITESPACE = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITESPACE)] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of text that one call of a kernel takes; a longer document is a chunk of its own.
CHUNK_BYTES = 256 << 10


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    start = U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    with np.errstate(over="ignore"):
        return mix64(start + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base = int(seeded(seed, 1)[0]) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 1 << 16)
            steps = np.full(size, self.base, U64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = self.inverse
            self.down = np.cumprod(steps)


_TABLES: dict[int, tuple[np.ndarray, _Powers]] = {}


def _tables(seed: int) -> tuple[np.ndarray, _Powers]:
    if seed not in _TABLES:
        _TABLES[seed] = (seeded(seed, 256), _Powers(seed + 7919))
    return _TABLES[seed]


def chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) document ranges of at most ``limit`` bytes, at least one document each."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each document's first word (one more
    entry than documents)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over table values of its bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, U64)
    table, powers = _tables(seed)
    powers.to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum(table[data] * powers.up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Spans:
    """Hashes of byte ranges of a text, by sums over its prefixes."""

    def __init__(self, data: np.ndarray, seed: int):
        table, powers = _tables(seed)
        powers.to(len(data) + 1)
        self.down = powers.down
        self.sums = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(table[data] * powers.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def runs(self, n: int) -> np.ndarray:
        """Of all runs of n bytes, in order."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def ngrams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes (multilinear, then mixed); shorter by n - 1."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    factors = seeded(seed * 1000 + n, n) | U64(1)
    with np.errstate(over="ignore"):
        total = hashes[: len(hashes) - n + 1] * factors[0]
        for j in range(1, n):
            total += hashes[j : len(hashes) - n + 1 + j] * factors[j]
        return mix64(total)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk with the first-word table of ``words``: a mask over runs of n words that lie in
    one document, and the number of such runs in each document."""
    total = int(first[-1])
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    inside = np.zeros(max(total - n + 1, 0), bool)
    if len(inside):
        steps = np.zeros(total + 1, np.int64)
        has = counts > 0
        np.add.at(steps, first[:-1][has], 1)
        np.add.at(steps, first[:-1][has] + counts[has], -1)
        inside = np.cumsum(steps[: len(inside)]) > 0
    return inside, counts


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as LEB128 differences."""
    if not len(values):
        return b""
    gaps = np.empty(len(values), U64)
    gaps[0] = values[0]
    np.subtract(values[1:], values[:-1], out=gaps[1:])
    sizes = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        more = gaps >= U64(1 << (7 * k)) if 7 * k < 64 else np.zeros(len(gaps), bool)
        if not more.any():
            break
        sizes += more
    out = np.empty(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max())):
        here = sizes > k
        piece = ((gaps[here] >> U64(7 * k)) & U64(127)).astype(np.uint8)
        piece[sizes[here] > k + 1] |= 128
        out[at[here] + k] = piece
    return out.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The values that ``pack_sorted`` took."""
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, U64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.empty(len(ends), np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    sizes = ends - starts + 1
    gaps = (raw[starts] & 127).astype(U64)
    for k in range(1, int(sizes.max())):
        here = np.flatnonzero(sizes > k)
        gaps[here] |= (raw[starts[here] + k] & 127).astype(U64) << U64(7 * k)
    return np.cumsum(gaps, dtype=U64)
