"""Whole Arrow text columns as one UTF-8 byte buffer, so that numpy sees every document at once.

White space is the six ASCII characters of the contracts, each a single byte in UTF-8, so words
can be cut on bytes without decoding.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkwell.session import ship  # noqa: F401

SPACE = np.zeros(256, dtype=bool)
SPACE[9:14] = True
SPACE[32] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20
#: Bytes from which a range is hashed and compared by itself.
LONG = 512

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _libc = None

_STEP = 0x9E3779B97F4A7C15
_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches of about ``limit`` text bytes (a longer document stands alone)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        buf, off = utf8(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def cut_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = off[:-1][off[:-1] < n]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


@functools.lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _UNBASE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running sums from which ``rolling_hash`` follows."""
    up, _ = _power(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_tables()[buf] * up[:-1], out=out[1:])
    return out


def rolling_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of overlapping short byte ranges. Being linear, it has collisions that can be constructed, so it may
    choose minimisers, where equal bytes only have to give equal hashes, but never decide that bytes are equal."""
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes a round, each round scrambled; long ranges go through BLAKE2b.
    Ranges of equal length of up to eight bytes never collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_STEP) + np.uint64(seed))
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    lanes = _lanes(buf)
    live = np.flatnonzero(size <= LONG) if len(long) else np.arange(len(size))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] * np.uint64(_BASE) ^ (lanes[at] & _LOW[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at ``a`` and ``b`` are equal."""
    out = np.ones(len(a), bool)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(buf[a[i] : a[i] + size[i]], buf[b[i] : b[i] + size[i]])
    lanes, live = _lanes(buf), np.flatnonzero(size <= LONG)
    a, b, left = a[live], b[live], size[live]
    while len(live):
        equal = (lanes[a] ^ lanes[b]) & _LOW[np.minimum(left, 8)] == 0
        out[live[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n consecutive values, scrambled at each doubling (rows are the caller's concern)."""
    count = len(words) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    width, at, rest, runs = 1, 0, n, words
    while rest:
        if rest & 1:
            out = mix(out * np.uint64(_BASE) ^ runs[at : at + count])
            at += width
        rest >>= 1
        if rest:
            runs = mix(runs[:-width] * np.uint64(_BASE) ^ runs[width:])
            width *= 2
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def tidy() -> None:
    """Give freed memory back to the system, between groups of a worker that lives on."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def span_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint union of half-open ranges; touching ranges join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]
