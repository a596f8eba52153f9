"""The stored tables of analyses: inserts that never replace, upserts, and deletes.

Each table is Parquet under one root, partitioned by the ids it is deleted by, so that every
change reads and writes the partitions it touches and no other.  A change is first written
in full to the shared scratch folder and read back from there: the table being changed may
be an input of the new rows, and a failed job leaves it as it was.  One writer at a time.

Ids in partition columns are text.  A null id has a partition of its own.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from isoscope.functions.catalogue import IDENTITY_COLUMNS
from isoscope.operators.dedup import drop_identity_conflicts
from isoscope.plans.lineage import delete_path, discard, exists, materialize

# partition columns; the order is that of a cascade delete: children first, the analysis last
LAYOUT = {
    "tags": ["deep_analysis_id"],
    "features": ["analysis_id"],
    "deep_analyses": ["analysis_id", "deep_analysis_id"],
    "sample_groups": ["analysis_id"],
    "events": ["analysis_id", "event_type"],
    "analyses": ["analysis_id"],
}


class Store(NamedTuple):
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame | None:
        """The table, or None before its first row."""
        if not exists(self.spark, self.path(table)):
            return None
        found = self.spark.read.parquet(self.path(table)).schema
        # ids such as 007 stay text
        fields = [StructField(f.name, StringType()) if f.name in LAYOUT[table] else f for f in found]
        return self.spark.read.schema(StructType(fields)).parquet(self.path(table))


def _touched(rows: DataFrame, by: list[str]) -> Column:
    """Whether a stored row lies in a partition that `rows` have: as many terms as one load has
    partitions."""
    places = rows.select(*by).distinct().collect()
    return reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(p[c])) for c in by]) for p in places
    ], F.lit(False))


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those of `gone`; nulls are equal."""
    other = gone.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], "left_anti")


def _write(store: Store, table: str, rows: DataFrame, mode: str) -> int:
    """Write by way of the scratch folder; `overwrite` replaces the partitions in `rows`."""
    by = LAYOUT[table]
    staged = materialize(rows.withColumns({c: F.col(c).cast("string") for c in by}), f"staged-{table}")
    n = staged.count()
    if n:
        staged.repartition(*by, F.pmod(F.xxhash64(*staged.columns), F.lit(64))).write.mode(mode).option(
            "partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(store.path(table))
    discard(staged)
    return n


def insert_events(store: Store, events: DataFrame) -> int:
    """Add the events whose identity (analysis, type, gene, place; nulls equal) is not stored
    yet, and return how many these are.  Of several new rows of one identity the best by
    priority is added; a stored row is never replaced.  Loading the same rows again adds none."""
    best = drop_identity_conflicts(events, null_safe=True)
    held = store.read("events")
    if held is not None:
        keys = [c for c in ["analysis_id", *IDENTITY_COLUMNS] if c in events.columns and c in held.columns]
        best = _without(best, held.where(_touched(events, LAYOUT["events"])), keys)
    return _write(store, "events", best, "append")


def insert(store: Store, table: str, rows: DataFrame, keys: list[str]) -> int:
    """Add the rows whose key is not stored yet (nulls equal), and return how many.  Of
    several new rows of one key the one of least hash is added."""
    one = _one_per_key(rows, keys)
    held = store.read(table)
    if held is not None:
        one = _without(one, held.where(_touched(rows, LAYOUT[table])), keys)
    return _write(store, table, one, "append")


def _one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(store: Store, table: str, rows: DataFrame, keys: list[str]) -> int:
    """Replace the stored rows of the new rows' keys, all columns, and add the others; returns
    the number of new rows.  A key names the partition too: a row is not sought in others."""
    # the new rows may be read from the table that is about to change
    new = materialize(_one_per_key(rows, keys), "upserted")
    n, held, merged = new.count(), store.read(table), new
    if held is not None:
        old = held.where(_touched(new, LAYOUT[table])).select(*rows.columns)
        merged = _without(old, new, keys).unionByName(new)
    _write(store, table, merged, "overwrite")
    discard(new)
    return n


def drop_partitions(store: Store, table: str, where: Column) -> int:
    """Delete whole partitions, given by a condition on partition columns; returns their
    number.  The files of no other partition are listed or opened."""
    held = store.read(table)
    if held is None:
        return 0
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    # one row per partition that goes
    folders = [unquote(r["f"]) for r in held.where(where).select(folder.alias("f")).distinct().collect()]
    for path in folders:
        delete_path(store.spark, path)
    return len(folders)


def delete_deep_analysis(store: Store, deep_analysis_id: str) -> None:
    """Delete one deep analysis and its tags."""
    for table in ("tags", "deep_analyses"):
        drop_partitions(store, table, F.col("deep_analysis_id") == deep_analysis_id)


def delete_analysis(store: Store, analysis_id: str) -> dict[str, int]:
    """Delete an analysis and all that hangs on it; returns the partitions dropped per table.

    Tags are reached through the analysis's deep analyses.  What others point to goes last,
    so a delete that failed half-way can be called again.
    """
    deep = store.read("deep_analyses")
    mine = F.col("analysis_id") == analysis_id
    ids = [] if deep is None else [
        r["deep_analysis_id"] for r in deep.where(mine).select("deep_analysis_id").distinct().collect()]
    return {
        table: drop_partitions(store, table, F.col("deep_analysis_id").isin(ids) if table == "tags" else mine)
        for table in LAYOUT
    }
