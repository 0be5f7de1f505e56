"""Vectorised text helpers that run inside Arrow tasks.

A *block* is a run of rows of one Arrow batch laid end to end in a byte
buffer.  Blocks are cut at ``BLOCK_BYTES`` so that the temporaries of a task
(a few machine words per byte) stay small whatever the batch holds; one text
longer than that forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

# ASCII white space: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RND = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


class Block(NamedTuple):
    first: int            # row of the batch that the block starts with
    buf: np.ndarray       # uint8, the texts end to end
    starts: np.ndarray    # start of each row's text
    ends: np.ndarray      # end of each row's text


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(buffer, offsets)`` of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(col: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``size`` bytes.  A text that is longer comes in several
    blocks of one row each, cut before white space, so no word is split."""
    data, off = column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        if j > i:
            j = min(j, n)
            yield Block(i, data[off[i]:off[j]], off[i:j] - off[i], off[i + 1:j + 1] - off[i])
            i = j
            continue
        at, end = int(off[i]), int(off[i + 1])
        while at < end:
            to = min(at + size, end)
            while to < end and not _SPACE[data[to]]:
                gap = np.flatnonzero(_SPACE[data[to:to + size]])
                to = to + int(gap[0]) if len(gap) else min(to + size, end)
            yield Block(i, data[at:to], np.zeros(1, np.int64), np.array([to - at]))
            at = to
        i += 1


def row_values(col: pa.Array | pa.ChunkedArray,
               of: Callable[[Block], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, values, first value of each row and the end)``.

    ``of(block)`` gives the values of a block and where each row's begin; those
    of a text that came in several blocks are put together.
    """
    held: list[tuple[int, np.ndarray]] = []

    def let_go() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if held:
            v = np.concatenate([x for _, x in held])
            yield held[0][0], v, np.array([0, len(v)])
            held.clear()

    for b in blocks(col):
        values, first = of(b)
        if held and held[0][0] != b.first:
            yield from let_go()
        if len(b.starts) == 1:
            held.append((b.first, values))
        else:
            yield b.first, values, first
    yield from let_go()


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


class Words(NamedTuple):
    starts: np.ndarray    # byte positions in the block
    ends: np.ndarray
    first: np.ndarray     # per row: index of its first word; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(b: Block, extra_cut: np.ndarray | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row.  ``extra_cut[i]`` also ends a
    word before byte ``i``."""
    n = len(b.buf)
    inside = ~_SPACE[b.buf]
    new = np.zeros(n + 1, bool)
    new[b.starts] = True
    if extra_cut is not None:
        new[:n] |= extra_cut
    begin = inside.copy()
    if n:
        begin[1:] &= ~inside[:-1] | new[1:n]
    last = inside.copy()
    if n:
        last[:-1] &= ~inside[1:] | new[1:n]
    s = np.flatnonzero(begin)
    e = np.flatnonzero(last) + 1
    bounds = np.append(b.starts, n)
    return Words(s, e, np.searchsorted(s, bounds))


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("p")
    if have is None or len(have) < n:
        m = max(n, BLOCK_BYTES + 1)
        p = np.full(m, _BASE, np.uint64)
        q = np.full(m, _INV, np.uint64)
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if m > 8 * BLOCK_BYTES:  # one very long text: not worth keeping
            return p[:n], q[:n]
        _POW["p"], _POW["q"] = p, q
    return _POW["p"][:n], _POW["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over random byte values (mod 2^64)."""
    return prefix_sums(byte_symbols(buf))


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return _RND[buf]


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """The same over symbols that are 64-bit hashes."""
    n = len(h)
    p, _ = _powers(n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(h * p[:n], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``buf[s:e]`` for many spans, from ``prefix_hash(buf)``."""
    _, q = _powers(len(c))
    h = (c[ends] - c[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(_BASE)
        out += h[i:i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concat(arange(s, s + n))`` without a loop."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; an empty segment gives 0."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


class HashIndex:
    """Sorted 64-bit hashes with a row number each, for values met before."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hash)

    def missing(self, h: np.ndarray) -> np.ndarray:
        """Places in the sorted, distinct ``h`` that are not known."""
        p = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = p < len(self.hash)
        known[inside] = self.hash[p[inside]] == h[inside]
        return np.flatnonzero(~known)

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        p = np.searchsorted(self.hash, h)
        self.hash = np.insert(self.hash, p, h)
        self.row = np.insert(self.row, p, rows)

    def rows(self, h: np.ndarray) -> np.ndarray:
        return self.row[np.searchsorted(self.hash, h)]
