"""Comma-separated replicate cells -> arrays, and per-row statistics over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tokens(cell: Column) -> Column:
    return F.transform(F.split(cell, ","), lambda t: F.trim(t))


def count_list(cell: Column) -> Column:
    """Replicate counts.  Blank tokens vanish (and so shift the pairing); a token
    that is not a finite number becomes null.  A missing cell is an empty list."""
    kept = F.filter(_tokens(cell), lambda t: t != "")
    # a NaN or infinite double has no bigint and so becomes null as well
    parsed = F.transform(kept, lambda t: t.try_cast("double").try_cast("bigint"))
    return F.coalesce(parsed, F.array().cast("array<bigint>"))


def psi_list(cell: Column) -> Column:
    """PSI values that are finite and inside [0, 1]; everything else is dropped."""
    values = F.transform(_tokens(cell), lambda t: t.try_cast("double"))
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    return F.coalesce(kept, F.array().cast("array<double>"))


def display_mean_psi(cell: Column) -> Column:
    """Mean of every numeric token, without the range check of `psi_list`; a
    blank token of a present cell reads as zero, as a number cast does."""
    numbers = F.transform(
        _tokens(F.when(F.length(cell) > 0, cell)),
        lambda t: F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double")),
    )
    return mean(F.filter(numbers, lambda v: v.isNotNull() & ~F.isnan(v)))


def mean(values: Column) -> Column:
    """Mean of the non-null elements of an array, null when there are none.  One pass:
    the array expression is evaluated once."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct(
            (acc["total"] + F.coalesce(v.cast("double"), F.lit(0.0))).alias("total"),
            (acc["n"] + v.isNotNull().cast("int")).alias("n"),
        ),
        lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"]),
    )


def mean_coverage(inclusion_cell: Column, skipping_cell: Column) -> Column:
    """Mean inclusion + skipping count over the replicate pairs where both parse;
    pairs beyond the shorter list are ignored.  Null when no pair is usable."""
    # zip_with pads the shorter list with nulls, whose sums are null and do not count
    return mean(
        F.zip_with(count_list(inclusion_cell), count_list(skipping_cell), lambda i, s: i + s)
    )
