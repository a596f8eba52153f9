"""Near-duplicate removal: a priority-ordered greedy suppression.

Inside a group (event type, gene, chromosome, strand; nulls form a group of their
own) rows are taken best first: FDR ascending, |effect| descending, nulls last,
then event id.  A row is dropped when a row ALREADY KEPT is near it:

* SE: start within `bp`, or end within `bp`;
* RI: start and end within `bp`;  MXE: all four boundaries within `bp`;
* A3SS / A5SS (and unknown types): exactly equal coordinates.

A row suppressed by a suppressed row stays, so neither a pairwise anti-join nor
connected components would be right.  One path for every size:

1. Only ids, coordinates and priority are read.  Rows with equal compared coordinates
   have equal neighbours, so only the best of them can survive: `row_number() = 1`,
   which Spark limits before the shuffle.  This alone decides A3SS / A5SS.
2. A group falls into islands that no near pair can bridge: runs of touching cells of
   bp + 1 bases, found on the distinct cells of a group (at most chromosome length /
   bp of them, however many rows there are).
3. Each island is a short streaming pass in priority order.  Its state is the kept
   cells: at most one row per cell, so it is bounded by the island's length as well.
4. The kept ids go back to the whole rows in one join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.functions.catalogue import ALT_SITE_COORDS, GENERIC_COORDS, NEAR_BP
from isoscope.plans.lineage import materialize

GROUP = ["event_type", "gene_id", "chr", "strand"]
BOUNDS = ["b0", "b1", "b2", "b3"]
# boundary sets per type: near when ANY set has ALL its boundaries within bp
NEAR_RULES = {"SE": [[0], [1]], "RI": [[0, 1]], "MXE": [[0, 1, 2, 3]]}


def priority() -> list[Column]:
    return [
        F.col("fdr").asc_nulls_last(),
        F.abs("inc_level_difference").desc_nulls_last(),
        F.col("event_id"),
    ]


def _priority_key() -> Column:
    """The same order as one comparable value (struct nulls would sort first)."""
    effect = F.abs("inc_level_difference")
    return F.struct(
        F.col("fdr").isNull().alias("f0"), F.coalesce("fdr", F.lit(0.0)).alias("f1"),
        effect.isNull().alias("f2"), F.coalesce(-effect, F.lit(0.0)).alias("f3"),
        F.col("event_id").alias("id"),
    )


def _group_key() -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in GROUP])


def compared_coordinates() -> Column:
    """The coordinates whose equality makes two rows interchangeable."""
    kind = F.col("event_type")
    array = lambda names: F.array(*[F.col(n).cast("bigint") for n in names])
    return (
        F.when(kind.isin("SE", "RI"), array(["exon_start", "exon_end"]))
        .when(kind == "MXE", array(
            ["exon_start", "exon_end", "second_exon_start", "second_exon_end"]))
        .when(kind.isin("A3SS", "A5SS"), array(ALT_SITE_COORDS))
        .otherwise(array(GENERIC_COORDS))
    )


def _incomparable() -> Column:
    """Rows no rule can compare: always kept, never a reference for others."""
    start, end = F.col("exon_start").isNull(), F.col("exon_end").isNull()
    second = F.col("second_exon_start").isNull() | F.col("second_exon_end").isNull()
    kind = F.col("event_type")
    return (
        F.when(kind == "SE", start & end)
        .when(kind == "RI", start | end)
        .when(kind == "MXE", start | end | second)
        .otherwise(F.lit(False))
    )


def best_of_equal(events: DataFrame) -> DataFrame:
    """Step 1: id, group, boundaries and priority of the best row of every set with
    equal compared coordinates."""
    two = F.col("event_type") == "MXE"
    narrow = events.where(~_incomparable()).select(
        "event_id", "event_type", _group_key().alias("gk"), compared_coordinates().alias("coords"),
        F.col("exon_start").alias("b0"), F.col("exon_end").alias("b1"),
        F.when(two, F.col("second_exon_start")).alias("b2"),
        F.when(two, F.col("second_exon_end")).alias("b3"),
        _priority_key().alias("prio"),
    )
    w = Window.partitionBy("gk", "coords").orderBy("prio")
    return narrow.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "coords")


def with_islands(rows: DataFrame, bp: int) -> DataFrame:
    """Step 2: adds `lo`, the first cell of a row, and its `island`.

    Near rows share or touch a cell of their reach: from start to end for SE, where
    either boundary may be near, and the start alone for RI and MXE.
    """
    cell = lambda c: F.floor(c / (bp + 1))
    low, high = F.least("b0", "b1"), F.greatest("b0", "b1")  # of the known boundaries
    either = F.col("event_type") == "SE"
    placed = rows.withColumns({
        "lo": cell(F.when(either, low).otherwise(F.col("b0"))),
        "hi": cell(F.when(either, high).otherwise(F.col("b0"))),
    })
    reach = placed.groupBy("gk", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("gk").orderBy("lo")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        reach.withColumn("before", F.max("hi").over(earlier))
        .withColumn("new", F.coalesce(F.col("lo") > F.col("before") + 1, F.lit(True)).cast("int"))
        .select("gk", "lo", F.sum("new").over(order).alias("island"))
    )
    return placed.drop("hi").join(islands, ["gk", "lo"])


# -- step 3 -------------------------------------------------------------------------
def _greedy_pass(bp: int):
    """Streaming pass over rows sorted by (group, island, priority).

    Cells are bp + 1 wide, so a cell can hold one kept row per boundary set, and
    any near kept row lies in an adjacent cell.  A row alone in its island is kept
    without looking further.
    """
    width = bp + 1

    def near_kept(kept: dict, values: tuple) -> bool:
        home = [v // width for v in values]
        for shift in product((-1, 0, 1), repeat=len(values)):
            other = kept.get(tuple(h + s for h, s in zip(home, shift, strict=True)))
            if other is not None and all(
                abs(v - o) <= bp for v, o in zip(values, other, strict=True)
            ):
                return True
        return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, kept = None, []
        for batch in batches:
            if batch.empty:
                continue
            place = list(zip(batch["gk"], batch["island"], strict=True))
            keep = np.ones(len(batch), bool)
            starts = np.ones(len(batch) + 1, bool)
            starts[1:-1] = [x != y for x, y in zip(place, place[1:], strict=False)]
            starts[0] = place[0] != island
            # the last island of a batch may go on in the next one
            alone = starts[:-1] & starts[1:]
            alone[-1] = False
            rows = np.flatnonzero(~alone)
            part = batch.iloc[rows]
            bounds = [part[b].astype("object").where(part[b].notna(), None) for b in BOUNDS]
            for at, kind, *values in zip(rows, part["event_type"], *bounds, strict=True):
                rules = NEAR_RULES[kind]
                if starts[at]:
                    kept = [{} for _ in rules]
                keys = [
                    None if any(values[i] is None for i in rule)
                    else tuple(int(values[i]) for i in rule)
                    for rule in rules
                ]
                if any(k is not None and near_kept(s, k)
                       for k, s in zip(keys, kept, strict=True)):
                    keep[at] = False
                    continue
                for k, seen in zip(keys, kept, strict=True):
                    if k is not None:
                        seen[tuple(v // width for v in k)] = k
            island = place[-1]
            yield batch.loc[keep, ["event_id"]]

    return run


def kept_ids(reduced: DataFrame, bp: int = NEAR_BP) -> DataFrame:
    """Ids surviving the near rules among the SE, RI and MXE rows of step 1."""
    id_type = reduced.schema["event_id"].dataType.simpleString()
    near = reduced.where(F.col("event_type").isin(*NEAR_RULES))
    return (
        with_islands(near, bp).repartition("gk", "island")
        .sortWithinPartitions("gk", "island", "prio")
        .select("gk", "island", "event_type", "event_id", *BOUNDS)
        .mapInPandas(_greedy_pass(bp), f"event_id {id_type}")
    )


def deduplicate(events: DataFrame, bp: int = NEAR_BP) -> DataFrame:
    """All rules together; same columns out as in.

    Of comparable rows with one event id the best is kept; incomparable rows stay all.
    """
    reduced = materialize(best_of_equal(events), "dedup-best")
    exact = reduced.where(~F.coalesce(F.col("event_type").isin(*NEAR_RULES), F.lit(False)))
    ids = kept_ids(reduced, bp).unionByName(exact.select("event_id")).withColumn(
        "_kept", F.lit(True)).dropDuplicates(["event_id"])
    # the window uses the partitioning of the join
    first = Window.partitionBy("event_id", "_free").orderBy(*priority())
    return (
        events.withColumn("_free", _incomparable()).join(ids, "event_id", "left")
        .where("_free OR _kept")
        .withColumn("_n", F.row_number().over(first)).where("_free OR _n = 1")
        .select(events.columns)
    )


def collapsed_by_type(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed per event type."""
    b = before.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, "event_type", "left").select(
        "event_type", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"),
        (F.col("n_before") - F.coalesce("n_after", F.lit(0))).alias("n_collapsed"),
    )


def drop_identity_conflicts(events: DataFrame, null_safe: bool = False) -> DataFrame:
    """The storage identity key.  With SQL semantics (the default) a null column
    makes rows distinct and every type leaves some null, so nothing is removed;
    `null_safe` treats nulls as equal and keeps the best row."""
    from isoscope.functions.catalogue import IDENTITY_COLUMNS

    keys = [c for c in ["analysis_id", *IDENTITY_COLUMNS] if c in events.columns]
    w = Window.partitionBy(*keys).orderBy(*priority())
    ranked = events.withColumn("_n", F.row_number().over(w))
    if null_safe:
        return ranked.where("_n = 1").drop("_n")
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    complete = events.where(~has_null).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return complete.drop("_n").unionByName(events.where(has_null))
