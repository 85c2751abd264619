"""Vectorised text kernels on Arrow buffers, shared by the operators of this subpackage.

Everything here works on whole texts as UTF-8 bytes, many documents in one buffer.

A word's code is a sum modulo 2**64 of random values, one for each (place in the word, byte), mixed into 1 .. PRIME - 1. A run of words has the
Rabin-Karp hash of its codes modulo the prime 2**61 - 1 with a random base, built by doubling. For two given different runs of n words the chance
of equal hashes is about n / 2**61, whatever their content; hashes modulo a power of two don't have that (Thue-Morse strings meet under any
base), so `byte_runs`, which is one, only serves where an equal hash decides nothing.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text hashed at once; a longer single text is a chunk of its own

PRIME = np.uint64(2**61 - 1)
PLACES = 64  # places in a word whose values are tabulated
_rng = np.random.default_rng(20240611)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE = 0x9E3779B97F4A7C1B  # odd
SEED, STRIDE = (np.uint64(x) for x in _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
BASE = int(_rng.integers(2**32, 2**61 - 2))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def place_value(key: np.ndarray) -> np.ndarray:
    """The random value of place * 256 + byte."""
    return mix(mix(key.astype(np.uint64) * STRIDE + SEED) + STRIDE)


PLACE_VALUES = place_value(np.arange(256 * PLACES))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(o) == 0:
        o = np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, size: int = CHUNK):
    """Ranges of documents of about `size` bytes."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+` in the buffer, and the index of each document's first word (one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offs[(offs > 0) & (offs < len(buf))]
    before[edges], after[edges - 1] = True, True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code below PRIME, never 0, for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32 if len(buf) < 2**30 else np.int64)
    body = buf[place + np.repeat(starts - first, size).astype(place.dtype)]
    place -= np.repeat(first, size).astype(place.dtype)
    value = PLACE_VALUES[np.minimum(place, PLACES - 1) * 256 + body]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value[far] = place_value(place[far].astype(np.uint64) * np.uint64(256) + body[far])
    return mix(np.add.reduceat(value, first)) % (PRIME - np.uint64(1)) + np.uint64(1)


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME for a, b < PRIME."""
    low, high = np.uint64(b & 0x7FFFFFFF), np.uint64(b >> 31)
    a0, a1 = a & np.uint64(0x7FFFFFFF), a >> np.uint64(31)
    mid = a1 * low + a0 * high  # below 2**62; times 2**31, where 2**61 is 1
    s = (a1 * high << np.uint64(1)) + a0 * low + (mid >> np.uint64(30)) + ((mid & np.uint64(0x3FFFFFFF)) << np.uint64(31))
    return reduced(s)


def reduced(s: np.ndarray) -> np.ndarray:
    s = (s & PRIME) + (s >> np.uint64(61))
    return np.where(s >= PRIME, s - PRIME, s)


def runs_of(codes: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `length` codes, spread over 64 bits."""
    if length < 1 or len(codes) < length:
        return np.zeros(0, np.uint64)
    joined = lambda x, y, at, power: reduced(times(x[: len(y) - at], power) + y[at:])
    whole, done, part, size, power = None, 0, codes, 1, BASE
    while True:
        if length & size:
            whole, done = (part, size) if whole is None else (joined(whole, part, done, power), done + size)
        if done == length:
            return mix(whole[: len(codes) - length + 1])
        part, power, size = joined(part, part, size, power), power * power % int(PRIME), 2 * size


def byte_runs(buf: np.ndarray, length: int) -> np.ndarray:
    """A hash modulo 2**64 of every run of `length` bytes: equal runs have equal hashes, different ones may."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(BYTE_BASE, len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODES[buf] * p, out=sums[1:], dtype=np.uint64)
    return mix((sums[length:] - sums[:-length]) * inv[:n])


def within(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a run of `length` words stays in its document, and the document of each."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(len(doc)) - skip[doc] + first[:-1][doc], doc


def cover(n: int, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in a window [at, at + length)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, highest first: sorted values then compress well."""
    w = x.dtype.itemsize
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, w).T).tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(w, -1).T).view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


def trim() -> None:
    """Gives memory that a task no longer needs back to the system: workers live on, and many share a machine."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function for mapInArrow that trims when its task ends."""

    def of(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return of
