"""Global running totals and row numbers without a one-task window.

Rows are range-partitioned by the full order, written once together with the
index of their range, and summed in two levels: inside a range (one window per
range) and across ranges (one tiny row per range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.plans.lineage import materialize


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(
        df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()),
        "ranged",
    )


def running_totals(
    df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]
) -> DataFrame:
    """Adds, per group and in the given order, the totals of all EARLIER rows.

    `sums` maps a new column name to the summed column.  The order must be total
    inside a group, otherwise tied rows see an arbitrary order.
    """
    ranged = _ranged(df, [F.col(c) for c in group + order])
    totals = ranged.groupBy(*group, "_range").agg(
        *[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()]
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = ranged.select(
        "*", *[F.coalesce(F.sum(src).over(inside), F.lit(0)).alias(f"_l_{new}")
               for new, src in sums.items()],
    )
    joined = local.join(offsets, [*group, "_range"])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based global row number in a total order."""
    ranged = _ranged(df, order)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: at most spark.sql.shuffle.partitions rows in this window
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_i", F.row_number().over(inside)).join(offsets, "_range")
    return numbered.select(*df.columns, (F.col("_i") + F.col("_before")).alias(name))


CELL = 1 << 16  # values below CELL * CELL: at most CELL cells, at most CELL values in each


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., <column>_median...): exact medians of whole-number columns, selected from
    counts per distinct value; nulls do not count, a group of nulls has a null median.

    First the cells of values that hold the middle ranks are found from one count per
    cell, then the values in these cells.  Rows are counted before any shuffle, and a window
    never holds more than CELL rows for values up to 2^32 (longer than any contig).
    """
    names = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.explode(F.array(*[
        F.struct(F.lit(c).alias("_column"), F.col(c).cast("bigint").alias("_v")) for c in columns])).alias("x")
    ).select(*names, "x.*").where("_v IS NOT NULL")
    key = [*names, "_column"]
    counts = rows.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_cell", F.floor(F.col("_v") / CELL))
    group = Window.partitionBy(*key)
    cells = counts.groupBy(*key, "_cell").agg(F.sum("_n").alias("_in")).withColumns({
        "_upto": F.sum("_in").over(group.orderBy("_cell")), "_all": F.sum("_in").over(group)})
    # the two middle ranks, equal for an odd number of rows
    ranks = cells.withColumn("_rank", F.explode(F.expr("array((_all + 1) div 2, _all div 2 + 1)"))).where(
        "_upto - _in < _rank AND _rank <= _upto")
    # one row for a cell that holds both ranks; joined under other names, nulls equal
    held = ranks.groupBy(*key, "_cell", "_upto", "_in", "_all").agg(F.lit(1).alias("_once")).select(
        *[F.col(c).alias(f"r{c}") for c in [*key, "_cell"]], "_all", (F.col("_upto") - F.col("_in")).alias("_before"))
    inside = counts.join(held, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in [*key, "_cell"]])
    running = inside.withColumn("_last", F.col("_before") + F.sum("_n").over(
        Window.partitionBy(*key, "_before").orderBy("_v")))
    middle = running.withColumn("_rank", F.explode(F.expr("array((_all + 1) div 2, _all div 2 + 1)"))).where(
        "_last - _n < _rank AND _rank <= _last")
    return middle.groupBy(*names).agg(*[
        F.avg(F.when(F.col("_column") == c, F.col("_v"))).alias(f"{c}_median") for c in columns
    ]).withColumnsRenamed(dict(zip(names, by, strict=True)))
