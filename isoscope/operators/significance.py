"""Event filters, the significance rule and deep-analysis tags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_significant(fdr_max: float, effect_min: float, p_max: float | None = None) -> Column:
    """Inclusive thresholds; a null statistic is never significant."""
    rule = (F.col("fdr") <= fdr_max) & (F.abs("inc_level_difference") >= effect_min)
    if p_max is not None:
        rule = rule & (F.col("p_value") <= p_max)
    return F.coalesce(rule, F.lit(False))


def filter_events(
    events: DataFrame, *, event_type: str | None = None, gene_symbol: str | None = None,
    fdr_max: float | None = None, p_value_max: float | None = None,
    effect_min: float | None = None,
) -> DataFrame:
    """List filters; `%` and `_` inside the symbol act as wildcards."""
    if event_type:
        events = events.where(F.col("event_type") == event_type.upper())
    if gene_symbol:
        events = events.where(F.col("gene_symbol").ilike(f"%{gene_symbol}%"))
    if fdr_max is not None:
        events = events.where(F.col("fdr") <= fdr_max)
    if p_value_max is not None:
        events = events.where(F.col("p_value") <= p_value_max)
    if effect_min is not None:
        events = events.where(F.abs("inc_level_difference") >= effect_min)
    return events


def tag_events(
    events: DataFrame, deep_analysis_id: str, fdr_max: float, effect_min: float,
    p_max: float | None = None,
) -> DataFrame:
    """The tag table: one row per event of the analysis."""
    return events.select(
        F.lit(deep_analysis_id).alias("deep_analysis_id"),
        "event_id",
        is_significant(fdr_max, effect_min, p_max).alias("is_significant"),
    )


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("deep_analysis_id").agg(
        F.count_if("is_significant").alias("n_significant"),
        F.count_if(~F.col("is_significant")).alias("n_not_significant"),
    )


def deep_analysis_name(
    analyses: DataFrame, fdr_max: float, effect_min: float, p_max: float | None, day: dt.date
) -> DataFrame:
    """Adds `name`: up to three candidate symbols, thresholds and the date.
    `candidate_genes` is array<struct<symbol, ...>>."""
    symbols = F.slice(
        F.filter(
            F.transform("candidate_genes", lambda g: g["symbol"]),
            lambda s: s.isNotNull() & (s != ""),
        ), 1, 3,
    )
    genes = F.when(F.size(symbols) > 0, F.array_join(symbols, "_"))
    limits = f"FDR{fdr_max}-PSI{effect_min}" + ("" if p_max is None else f"-p{p_max}")
    return analyses.withColumn("name", F.concat_ws("-", genes, F.lit(limits), F.lit(str(day))))


def deep_analysis_events(
    events: DataFrame, tags: DataFrame, deep_analysis_id: str, significant: bool | None = None
) -> DataFrame:
    """Events of one deep analysis, optionally one side of it."""
    chosen = tags.where(F.col("deep_analysis_id") == deep_analysis_id)
    if significant is not None:
        chosen = chosen.where(F.col("is_significant") == significant)
    return events.join(chosen.select("event_id", "is_significant"), "event_id")
