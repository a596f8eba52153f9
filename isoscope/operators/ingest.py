"""From landed files to the cleaned event table, with its ledger."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoscope.functions.catalogue import MIN_COVERAGE, NEAR_BP
from isoscope.operators.coverage import drop_accounting, filter_low_coverage
from isoscope.operators.dedup import collapsed_by_type, deduplicate
from isoscope.plans.lineage import materialize
from isoscope.sources.event_tables import (
    event_type,
    first_lines,
    has_count_columns,
    header_fields,
    layouts,
    logical_name,
    read_events,
)


class Ingested(NamedTuple):
    events: DataFrame
    ledger: DataFrame
    collapsed: DataFrame


def clean(events: DataFrame, min_coverage: float = MIN_COVERAGE, bp: int = NEAR_BP) -> DataFrame:
    """Coverage filter, then de-duplication."""
    return deduplicate(filter_low_coverage(events, min_coverage), bp)


def ledger(parsed: DataFrame, covered: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: what was parsed, dropped, collapsed and stored."""
    n_covered = covered.agg(F.count(F.lit(1)).alias("n_covered"))
    n_stored = stored.agg(F.count(F.lit(1)).alias("n_stored"))
    # three one-row frames side by side
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(drop_accounting(parsed)).join(one(n_covered), "_one").join(one(n_stored), "_one")
    return row.select(
        F.col("n_total").alias("n_parsed"),
        F.when(F.col("n_covered") == F.col("n_total"), 0).otherwise(F.col("n_missing"))
        .alias("n_missing_counts"),
        F.when(F.col("n_covered") == F.col("n_total"), 0).otherwise(F.col("n_low"))
        .alias("n_low_coverage"),
        (F.col("n_covered") - F.col("n_stored")).alias("n_collapsed"),
        "n_stored",
    )


def ingest_files(
    spark: SparkSession, paths: list[str], analysis_id: str,
    min_coverage: float = MIN_COVERAGE, bp: int = NEAR_BP,
) -> Ingested:
    """Read, filter, de-duplicate.  Copies of one event in several files (the two
    counting modes) are merged by the de-duplication: the lowest FDR survives."""
    found = layouts(spark, paths)
    parsed = materialize(read_events(spark, paths, analysis_id, found), "parsed")
    # annotation-only input carries no counts at all: nothing to filter on
    covered = filter_low_coverage(parsed, min_coverage) if has_count_columns(spark, paths, found) else parsed
    stored = materialize(deduplicate(covered, bp), "ingested")
    return Ingested(stored, ledger(parsed, covered, stored), collapsed_by_type(covered, stored))


def warnings(spark: SparkSession, paths: list[str], events: DataFrame) -> DataFrame:
    """Files that are empty, unrecognised or contributed no row."""
    # the file index also knows empty files, which no scan returns
    listed = spark.read.option("recursiveFileLookup", "true").text(paths).inputFiles()
    # all sides as plain paths: lists and metadata have the escaped form, and file:/// for file:/
    plain = lambda path: F.regexp_replace(
        F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/+", "file:/")
    files = spark.createDataFrame([(p,) for p in listed], "path string").select(plain("path").alias("path"))
    name = logical_name(F.regexp_replace("path", "%", "%25"))
    kind = event_type(name, header_fields(F.col("header_line")))
    used = events.groupBy(plain("path").alias("path")).agg(F.count(F.lit(1)).alias("n_events"))
    return (
        files.join(first_lines(spark, paths), "path", "left").join(used, "path", "left")
        .select(
            name.alias("name"),
            F.when(F.col("header_line").isNull(), "empty file")
            .when(kind.isNull(), "unrecognised file")
            .when(F.col("n_events").isNull(), "no event in file").alias("warning"),
        )
        .where("warning IS NOT NULL")
    )
