"""Vectorised byte kernels shared by the text operators.

A chunk of documents is one UTF-8 byte array plus document offsets, exactly
as Arrow stores a string column, so no Python object is made per word.
Words are runs of bytes other than 0x20 and 0x09-0x0D, which are the runs of
characters ``[^\\x20\\x09-\\x0D]+`` since those bytes never occur inside a
multi-byte character.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: some fifty times this is what a worker holds beside its batch, 16 times for good (powers).
CHUNK_BYTES = 1 << 19

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.RandomState(20240501)
_MASK = (1 << 64) - 1
_BYTE = _rng.randint(0, 1 << 32, 256).astype(np.uint64) << np.uint64(32) | _rng.randint(0, 1 << 32, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEQ = 0xD6E8FEB86659FD93 | 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inv)):
                out = np.ones(1, np.uint64)
                while len(out) < size:
                    step = np.uint64(pow(base, len(out), 1 << 64))
                    out = np.concatenate([out, out * step])
                setattr(self, name, out)
        return self.up[:n], self.down[:n]


_BYTE_POW, _SEQ_POW = _Powers(_BASE), _Powers(_SEQ)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def give_back() -> None:
    """Return the freed memory of earlier work to the system; Spark uses Python workers again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives its freed memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


@dataclass
class Chunk:
    """Some documents: ``rows`` are their row numbers in the Arrow batch."""

    rows: slice
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``size`` bytes; a longer
    text is a chunk of its own. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        own = offsets[at : to + 1]
        yield Chunk(slice(at, to), buf[own[0] : own[-1]], own - own[0])
        at = to


@dataclass
class Words:
    """Byte spans of the words of a chunk; words of document i are
    ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk) -> Words:
    inside = IS_WORD[chunk.buf]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cuts = chunk.offsets[:-1]
    cuts = cuts[cuts < len(inside)]
    if len(inside):
        before[0] = False
        before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    cuts = cuts[cuts > 0]
    after[cuts - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets))


def word_hashes(buf: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(w.start):
        return np.empty(0, np.uint64)
    up, down = _BYTE_POW.get(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=run[1:])
    return mix((run[w.end] - run[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive entries (document ends are ignored)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    if n <= 8:
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out *= np.uint64(_SEQ)
            out += h[k : len(h) - n + 1 + k]
        return mix(out)
    up, down = _SEQ_POW.get(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=run[1:])
    return mix((run[n:] - run[:-n]) * down[: len(h) - n + 1])


def windows_inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-word windows that lie in one document, and their document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    shift = first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(int(counts.sum())) + shift[doc], doc


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i+1]]`` for each i, exact for integers."""
    run = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]
