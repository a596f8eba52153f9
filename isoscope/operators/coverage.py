"""Junction-coverage filter and its accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoscope.functions.catalogue import MIN_COVERAGE
from isoscope.functions.cells import mean_coverage

COUNT_COLUMNS = ["ijc_sample_1", "sjc_sample_1", "ijc_sample_2", "sjc_sample_2"]


def group_coverage() -> tuple[Column, Column]:
    a, b, c, d = (F.col(x) for x in COUNT_COLUMNS)
    return mean_coverage(a, b), mean_coverage(c, d)


def with_coverage_status(events: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Adds coverage_1, coverage_2 and coverage_status (kept / low / missing)."""
    one, two = group_coverage()
    status = (
        F.when(F.col("coverage_1").isNull() | F.col("coverage_2").isNull(), "missing")
        .when((F.col("coverage_1") < min_coverage) | (F.col("coverage_2") < min_coverage), "low")
        .otherwise("kept")
    )
    return events.withColumns({"coverage_1": one, "coverage_2": two}).withColumn(
        "coverage_status", status
    )


def filter_low_coverage(events: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Keep events covered in both groups; a no-op without the count columns."""
    if not set(COUNT_COLUMNS) <= set(events.columns):
        return events
    one, two = group_coverage()
    return events.where((one >= min_coverage) & (two >= min_coverage))


def drop_accounting(events: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row: n_total, n_low, n_missing, n_kept."""
    status = F.col("coverage_status")
    return with_coverage_status(events, min_coverage).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(status == "low").alias("n_low"),
        F.count_if(status == "missing").alias("n_missing"),
        F.count_if(status == "kept").alias("n_kept"),
    )
