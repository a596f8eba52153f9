"""Stored tables: insert, upsert, re-annotation and delete as rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETRY_AFTER = "INTERVAL 24 HOURS"


def store_events(events: DataFrame, path: str) -> None:
    """Replace exactly the (analysis, type) partitions that the frame holds."""
    (
        events.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("analysis_id", "event_type")
        .parquet(path)
    )


def load_events(spark: SparkSession, path: str, analysis_id: str | None = None) -> DataFrame:
    """Stored events; the filter prunes partitions."""
    stored = spark.read.parquet(path)
    return stored if analysis_id is None else stored.where(F.col("analysis_id") == analysis_id)


def upserted(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """New rows replace old rows of the same key, all columns included."""
    return old.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new)


def stale(features: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Ids of features without a transcript whose event has a gene id and whose last
    attempt is unknown or more than a day old."""
    with_gene = events.where(F.coalesce("gene_id", F.lit("")) != "").select("event_id")
    old = F.col("computed_at").isNull() | (now - F.col("computed_at") > F.expr(RETRY_AFTER))
    return features.where(F.col("transcript_id").isNull() & old).join(
        with_gene, "event_id", "left_semi").select("event_id")


def reannotated(
    features: DataFrame, events: DataFrame, models: DataFrame, now: Column
) -> DataFrame:
    """Features with the stale ones annotated again.  A row that still finds no
    transcript is stamped all the same, so it waits another day."""
    from isoscope.operators.features import EVENT_INPUTS, annotated

    due = stale(features, events, now)
    fresh = annotated(events.join(due, "event_id", "left_semi").select(*EVENT_INPUTS), models)
    renew = ["transcript_id", "exon_rank", "frame_region", "frame_class", "cds_exon_length"]
    tried = fresh.select("event_id", F.lit(True).alias("_due"),
                         *[F.col(c).alias(f"_new_{c}") for c in renew])
    found = F.col("_new_transcript_id").isNotNull()
    joined = features.join(tried, "event_id", "left")
    return joined.withColumns(
        {c: F.when(found, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in renew}
        | {"computed_at": F.when(F.col("_due"), now).otherwise(F.col("computed_at"))}
    ).select(features.columns)


def without_analysis(
    analysis_id: str, events: DataFrame, features: DataFrame, deep_analyses: DataFrame,
    tags: DataFrame,
) -> dict[str, DataFrame]:
    """Every table without an analysis and what hangs on it."""
    gone_events = events.where(F.col("analysis_id") == analysis_id).select("event_id")
    gone_deep = deep_analyses.where(F.col("analysis_id") == analysis_id).select("deep_analysis_id")
    other = ~F.col("analysis_id").eqNullSafe(analysis_id)
    return {
        "tags": tags.join(gone_deep, "deep_analysis_id", "left_anti"),
        "features": features.join(gone_events, "event_id", "left_anti"),
        "deep_analyses": deep_analyses.where(other),
        "events": events.where(other),
    }


def without_deep_analysis(
    deep_analysis_id: str, deep_analyses: DataFrame, tags: DataFrame
) -> dict[str, DataFrame]:
    other = ~F.col("deep_analysis_id").eqNullSafe(deep_analysis_id)
    return {"deep_analyses": deep_analyses.where(other), "tags": tags.where(other)}
