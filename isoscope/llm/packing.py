"""Best-fit packing with certified bin counts.

Every document becomes token pieces of at most `capacity`; pieces of full length are
sequences of their own.  The rest is dealt into groups of bounded size, and each group
is packed by best-fit decreasing.  Dual feasible functions bound the number of bins a
group needs from below: where the bound is met the group is certified and final.  Bins
with a gap of the other groups are opened again, and their pieces exchanged by a new deal
and packed anew, until all groups are certified or a round saves nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoscope.llm.bpe import codec
from isoscope.plans.lineage import materialize

CAPACITY = 2048
END_OF_DOCUMENT = 0
GROUP_PIECES = 100_000  # aimed-at pieces of a group, so a group fits a task at any size

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = "pid bigint, length bigint, sequence_id bigint, offset bigint, fill bigint, bound bigint"


# -- pieces --------------------------------------------------------------------------
def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; null text counts as empty (one piece, the end mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark = codec(path).encode_all, np.uint32(END_OF_DOCUMENT).tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += mark
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [f.split()[0] for f in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# -- one group -----------------------------------------------------------------------
def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins any packing needs, by two families of dual feasible functions.

    * For each e <= capacity / 2: sizes above capacity - e count as the capacity, sizes
      below e as nothing.
    * For each k: (k + 1) size / capacity rounded down, unless it is whole, in k-ths.
    """
    count = np.bincount(sizes, minlength=capacity + 1)[:capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    total = np.concatenate(([0], np.cumsum(count * size)))  # total[s]: sizes below s
    number = np.concatenate(([0], np.cumsum(count)))
    e = np.arange(capacity // 2 + 1)
    middle = total[capacity - e + 1] - total[e]
    large = (number[-1] - number[capacity - e + 1]) * capacity
    best = -(-(middle + large) // capacity).max()
    for k in range(1, 33):
        scaled = (k + 1) * size
        # in units of capacity / k: whole multiples keep their exact value
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return int(best)


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY):
    """(bin, offset) of each piece and the fill of each bin.

    Bins of one gap form a stack and a bit mask marks the gaps in use, so the tightest
    fitting gap is one lowest-set-bit step, whatever the number of bins.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    offset = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    fills: list[int] = []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, n
            n += 1
            fills.append(0)
        where[i], offset[i] = b, capacity - gap
        fills[b] += size
        left = gap - size
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return where, offset, np.array(fills, np.int64)


def _pack_group(capacity: int, round_no: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", kind="stable")
        sizes = rows["length"].to_numpy(np.int64)
        where, offset, fills = best_fit_decreasing(sizes, capacity)
        group = int(rows["grp"].iloc[0])
        return pd.DataFrame({
            "pid": rows["pid"].to_numpy(), "length": sizes,
            "sequence_id": (round_no << 56) + (group << 28) + where, "offset": offset,
            "fill": fills[where], "bound": lower_bound(sizes, capacity)})

    return run


# -- all groups ----------------------------------------------------------------------
def pack(sized: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows (pid, length) with unique pid and 1 <= length <= capacity to (pid,
    sequence_id, offset).  Runs jobs: one per round, over the open bins only."""
    full = sized.where(F.col("length") == capacity).select(
        "pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    remaining, done = sized.where(F.col("length") < capacity).select("pid", "length"), [full]
    groups_before, round_no, opened, opened_bins = 0, 0, None, 0
    while True:
        n = remaining.count()
        if not n:
            break
        groups = math.ceil(n / group_pieces)  # of bounded size in every round
        dealt = remaining.withColumn(
            "grp", F.pmod(F.xxhash64("pid", F.lit(round_no)), F.lit(groups)))
        placed = materialize(
            dealt.groupBy("grp").applyInPandas(_pack_group(capacity, round_no), PLACED), "packing")
        bins = group_bounds(placed).agg(F.sum("bins")).first()[0]
        round_no += 1
        if opened is not None and bins >= opened_bins:  # the exchange saved nothing
            done.append(opened)
            break
        # a group that meets its bound is final, and so are full bins; the other bins of
        # the other groups are opened again
        certified = F.col("certified") | (F.col("fill") == capacity)
        placed = placed.join(
            group_bounds(placed).select("grp", (F.col("bins") == F.col("bound")).alias("certified")),
            F.shiftright("sequence_id", 28) == F.col("grp"))
        done.append(placed.where(certified).select("pid", "sequence_id", "offset"))
        opened = placed.where(~certified).select("pid", "sequence_id", "offset")
        if groups == 1 and groups_before < 2:  # there is no one to exchange with
            done.append(opened)
            break
        remaining = placed.where(~certified).select("pid", "length")
        opened_bins = opened.agg(F.countDistinct("sequence_id")).first()[0]
        groups_before = groups
    return reduce(DataFrame.unionByName, done)


def group_bounds(placed: DataFrame) -> DataFrame:
    """(grp, bins, bound) of each packed group: its bins and the least number that any
    packing of its pieces needs.  Where they are equal the group is certified."""
    per_bin = placed.groupBy("sequence_id").agg(F.first("bound").alias("bound"))
    return per_bin.groupBy(F.shiftright("sequence_id", 28).alias("grp")).agg(
        F.count(F.lit(1)).alias("bins"), F.first("bound").alias("bound"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
           group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    Rows that repeat a doc_id are packed each on their own; null ids stay null.  An
    empty table gives an empty result.  Only lengths and checksums leave the tokenizing
    task, so nothing but narrow rows is shuffled.
    """
    table = materialize(
        pieces(docs, path, capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    places = pack(table, capacity, group_pieces)
    return table.join(places, "pid").drop("pid")


def certificate(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used and the least number that the token count allows."""
    return placed.agg(
        F.countDistinct("sequence_id").alias("sequences"),
        F.ceil(F.sum("length") / capacity).alias("lower_bound"))


