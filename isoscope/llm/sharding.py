"""Shards from a hierarchical weighted hash tree, in DataFrame functions only.

A key descends region, rack and shard.  At each node the children draw
-ln(u) / weight with u hashed from key and child, and the smallest draw wins, so a
child is taken with a probability in proportion to its weight.  A draw depends on its
own child only: raising a weight moves keys only into that child's subtree, lowering it
only out of it, and a new region takes keys only into itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIONS, RACKS, SHARDS_PER_RACK = 2, 4, 5
SLOT_BUCKETS = 256  # parts in which a shard's rows are numbered


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def uniform_tree(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS_PER_RACK):
    """Leaves numbered from 0 in tree order, all of weight one."""
    return [Leaf(f"r{i // (racks * shards)}", f"k{i // shards}", i)
            for i in range(regions * racks * shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no other node's weight changes, so it
    takes rows only into itself."""
    n = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"x{n}", f"x{n}", n, weight)]


def hash_share(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _winner(key: Column, level: str, children: dict[str, float], out) -> Column:
    """The child of least draw; equal draws go to the smaller name."""
    draws = [
        F.struct((-F.log(hash_share(key, F.lit(f"{level}:{name}"))) / F.lit(float(weight)))
                 .alias("draw"), F.lit(out(name)).alias("child"))
        for name, weight in sorted(children.items()) if weight > 0
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def _weights(leaves: Iterable[Leaf], name) -> dict[str, float]:
    total: dict[str, float] = {}
    for leaf in leaves:
        total[name(leaf)] = total.get(name(leaf), 0.0) + leaf.weight
    return total


def _by_parent(parent: Column, options: dict[str, Column]) -> Column:
    out = None
    for name, option in options.items():
        out = (F if out is None else out).when(parent == name, option)
    return out


def assign(rows: DataFrame, tree: list[Leaf], key: Column, out: str) -> DataFrame:
    """All columns plus the shard of each row (an existing `out` is replaced)."""
    rows = rows.drop(out).withColumn("_region", _winner(
        key, "region", _weights(tree, lambda x: x.region), str))
    racks = {r: _winner(key, "rack", _weights(
        [x for x in tree if x.region == r], lambda x: x.rack), str)
        for r in {x.region: 0 for x in tree}}
    rows = rows.withColumn("_rack", _by_parent(F.col("_region"), racks))
    shards = {k: _winner(key, "shard", _weights(
        [x for x in tree if x.rack == k], lambda x: str(x.shard)), int)
        for k in {x.rack: 0 for x in tree}}
    return rows.withColumn(out, _by_parent(F.col("_rack"), shards).cast("int")).drop(
        "_region", "_rack")


def number_slots(rows: DataFrame, shard: str, key: Column, order: list[str],
                 buckets: int = SLOT_BUCKETS) -> DataFrame:
    """All columns plus `slot`: gapless numbers from 0 inside each shard.

    A shard is numbered in hashed parts, which are sorted each on its own; the rows of
    earlier parts come from a count per part (shards x buckets rows).
    """
    rows = rows.withColumn("_part", F.floor(hash_share(key, F.lit("slot")) * buckets).cast("int"))
    counts = rows.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [shard, "_part"]).withColumn(
        "slot", F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")


def sharded(docs: DataFrame, tree: list[Leaf] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    doc_id and the tree decide, so rows that repeat a doc_id share a shard and get
    slots of their own.  A null doc_id is the key ''; a null text has 16 bytes and the
    checksum of an empty one.  Texts are reduced to size and checksum before any shuffle.
    """
    tree = tree or uniform_tree()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(assign(narrow, tree, key, "shard"), grown(tree), key, "grown_shard")
    slots = number_slots(placed, "shard", key, ["doc_id", "size", "text_crc32"])
    return slots.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"),
        "grown_shard")
