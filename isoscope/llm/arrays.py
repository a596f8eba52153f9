"""Vectorised text arithmetic inside Arrow batches: words, hashes, windows.

A batch of texts is handled as one byte array with document offsets, cut into
blocks of about half a megabyte (a longer document is a block of its own), so the
temporary arrays stay small whatever a batch holds.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 19
U = np.uint64

# byte classes: white space as 0x20 and 0x09-0x0D; letters and digits as ASCII
# alphanumerics plus every byte of a non-ASCII character
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def worker_state(key: str, make, owner: str):
    """A value built once per Python worker.  The package travels by value, so its
    own globals are new in each task; a module entry outlives them.

    Workers serve stage after stage: only the values of one owner are held, those of
    the one before are dropped and their memory is given back."""
    holder = sys.modules.setdefault("_isoscope_worker_state", types.ModuleType("state"))
    if getattr(holder, "owner", owner) != owner:
        holder.__dict__.clear()
        release_memory()
    holder.owner = owner
    if not hasattr(holder, key):
        setattr(holder, key, make())
    return getattr(holder, key)


def release_memory() -> None:
    """Give unused memory of this worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def extended(schema: StructType, ddl: str) -> StructType:
    """A copy of the schema with more columns."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


class Block(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # n + 1 document offsets into data

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    if not len(column):
        return
    data, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        part = offsets[first:last + 1]
        yield Block(first, data[part[0]:part[-1]], part - part[0])
        first = last


class Words(NamedTuple):
    start: np.ndarray  # byte offsets
    end: np.ndarray
    doc: np.ndarray  # document of each word
    counts: np.ndarray  # words of each document
    first: np.ndarray  # n + 1 word offsets per document


def find_words(block: Block, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of the given class; runs never cross documents."""
    inside = kind[block.data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = block.offsets[:-1]
    edges = edges[edges < len(inside)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(block.offsets, start, "right") - 1
    counts = np.bincount(doc, minlength=block.n)
    return Words(start, end, doc, counts, np.concatenate(([0], np.cumsum(counts))))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(n + 1, base, U)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least.  A worker holds those of one
    block; a longer text's are made for it alone."""
    if n > BLOCK_BYTES:
        return _powers(n)
    return worker_state("powers", lambda: _powers(BLOCK_BYTES), "hashes")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial sum."""
    up, down = powers(len(data))
    table = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * up[:len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive values."""
    n = max(len(values) - size + 1, 0)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * U(0x2545F4914F6CDD1D) + values[j:j + n])
    return out


def shingles(block: Block, size: int = 5) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of word `size`-grams (lower-cased alphanumeric words) of each document
    and their offsets; a document of fewer words is one shingle of all of them."""
    words = find_words(block, ALNUM)
    hashes = span_hashes(LOWER[block.data], words.start, words.end)
    wide = window_hashes(hashes, size)
    n = np.maximum(words.counts - size + 1, np.minimum(words.counts, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(words.first[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    out = wide[np.minimum(at, len(wide) - 1)] if len(wide) else np.zeros(len(at), U)
    for d in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        own = hashes[words.first[d]:words.first[d + 1]]
        out[offsets[d]] = window_hashes(own, len(own))[0]
    return out, offsets, words


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def distinct_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)
