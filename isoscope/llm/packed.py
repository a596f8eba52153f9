"""Many narrow rows on their way from task to task, packed.

A task deals its rows (structured arrays) to buckets by a hash of one field and sends one
binary a bucket, so the JVM moves few large values; a bucket is put together, sorted and
worked on in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isoscope.llm.arrays import U, mix

PACKED = "bucket int, rows binary"
FLUSH = 1 << 24  # bytes that a task holds before it sends them
FINE = 8  # buckets to a partition: one is in memory at a time
PARTS = 64  # rows in which a task's counters travel


def binaries(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Values cut out of one array; offsets (n + 1) count its items."""
    raw = np.ascontiguousarray(data).reshape(-1).view(np.uint8)
    step = data.dtype.itemsize * int(np.prod(data.shape[1:], dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer((np.asarray(offsets, np.int64) * step)), pa.py_buffer(raw)]).cast(pa.binary())


def groups(*columns: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal rows that stand together, and the end of the last."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def deal(arrays: Iterable[np.ndarray], by: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows as PACKED, by a hash of the field `by`."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (mix(rows[by].astype(np.int64).view(U)) % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = groups(bucket)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts[:-1]]), binaries(rows[order], cuts)], ["bucket", "rows"])

    held, size = [], 0
    for rows in arrays:
        if not len(rows):
            continue
        held.append(rows)
        size += rows.nbytes
        if size >= FLUSH:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def arrived(batches: Iterable[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """The rows of each bucket, of PACKED rows sorted by bucket."""
    held, bucket = [], None
    for batch in batches:
        for b, value in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if held and b != bucket:
                yield np.concatenate(held)
                held = []
            bucket = b
            held.append(np.frombuffer(value.as_buffer(), dtype).copy())
    if held:
        yield np.concatenate(held)


def exchanged(source: DataFrame, make: Callable[[Iterator], Iterable[np.ndarray]], by: str) -> DataFrame:
    """PACKED rows of the arrays that `make` gives for the batches of `source`, those of a
    bucket together."""
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * FINE
    return source.mapInArrow(lambda batches: deal(make(batches), by, buckets), PACKED).repartition(
        parts, "bucket").sortWithinPartitions("bucket")


def by_document(packed: DataFrame, dtype: np.dtype, fields: list[str]) -> DataFrame:
    """(doc_id, asked): the fields of each document's rows as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrived(batches, dtype):
            rows = rows[np.argsort(rows["doc"], kind="stable")]
            cuts = groups(rows["doc"])
            kept = np.empty(len(rows), np.dtype([(f, dtype[f]) for f in fields]))
            for f in fields:
                kept[f] = rows[f]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc"][cuts[:-1]]), binaries(kept, cuts)], ["doc_id", "asked"])

    return packed.mapInArrow(run, "doc_id bigint, asked binary")


def slot_counts(texts: DataFrame, keys: Callable[[pa.Array], Iterable[np.ndarray]], slots: int) -> np.ndarray:
    """How many keys of ALL the texts fall in each of so many counters, by hash; `keys` gives
    the keys of a column of texts."""
    part = slots // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(slots, np.int64), [], 0
        for batch in batches:
            for found in keys(batch.column("text")):
                held.append((found & U(slots - 1)).astype(np.uint32))
                size += len(found)
                if size >= slots:
                    total += np.bincount(np.concatenate(held), minlength=slots)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=slots)
        if total.any():
            total = total.astype(np.min_scalar_type(int(total.max())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PARTS, dtype=np.int32)), binaries(total, np.arange(PARTS + 1) * part)],
                ["bucket", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, value in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
                raw = value.as_buffer()
                own = np.frombuffer(raw, np.dtype(f"u{raw.size // part}"))
                total[b] = total[b] + own if b in total else own.astype(np.int64)
        for b, own in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()),
                 pa.array([np.minimum(own, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())],
                ["bucket", "rows"])

    found = texts.mapInArrow(count, PACKED).repartition(
        min(PARTS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket"
    ).mapInArrow(add, PACKED).toArrow()
    out = np.zeros(slots, np.int32)
    for b, value in zip(found.column("bucket").to_pylist(), found.column("rows").to_pylist(), strict=True):
        out[b * part:(b + 1) * part] = np.frombuffer(value, np.int32)
    return out
