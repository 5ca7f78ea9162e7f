"""Vectorised text helpers for Arrow batches: byte buffers of many documents,
word spans and polynomial span hashes.

A span hash is ``sum(value[byte] * base**position)`` over prefix sums modulo
2**64, shifted to position 0 and mixed; one pass over the bytes gives the hash
of any span.  ``value`` is a fixed random table, so equal hashes of different
spans are as rare as for a random 64-bit function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}
BUFFER = 1 << 20  # bytes hashed at a time, unless one document is longer

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["pow"]) < n:
        size = max(n, BUFFER + 2)
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["pow"], _POWERS["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of ``data[start:end]``; equal spans have equal hashes."""
    _, inverse = _powers(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column without copying the bytes.
    A null has length 0."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def buffers(column: pa.Array, limit: int = BUFFER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents of about ``limit`` bytes: (first, end, bytes,
    offsets into bytes).  A longer document comes alone."""
    data, offsets = byte_column(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end
    pa.default_memory_pool().release_unused()  # a worker lives on between stages


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _SPACE,
          lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents ``data[offsets[i]:offsets[i+1]]``: (document,
    start, end, hash), in order.  ``table`` marks the bytes between words;
    A-Z are lower-cased before hashing."""
    space = table[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = ~space[start] if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    doc = np.searchsorted(offsets, start, "right") - 1
    prefix = prefix_hash(_LOWER[data] if lower else data)
    return doc, start, end, mix(span_hash(prefix, start, end) + (end - start).astype(np.uint64))
