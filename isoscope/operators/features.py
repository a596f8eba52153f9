"""Splice features of skipped-exon events: transcript model, windows, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoscope.functions import sequence as sq
from isoscope.functions.coordinates import (
    KNOWN,
    WINDOWS,
    as_long,
    exon_size,
    intron_sizes,
    splice_windows,
)
from isoscope.plans.overlap import overlap_join
from isoscope.sources.genome import Genome, known_contigs, resolved_contig, short_regions
from isoscope.sources.transcripts import unversioned


# -- transcript model ------------------------------------------------------------
def with_model(events: DataFrame, models: DataFrame) -> DataFrame:
    """Left join of the gene's representative transcript (`tx` struct, null when
    the gene has none).  The model table is one row per gene; Spark broadcasts it
    when it is small at run time and splits a hot gene otherwise."""
    tx = models.select(
        F.col("gene_id").alias("_g"),
        F.struct("transcript_id", "strand", "exons", "cds").alias("tx"),
    )
    return events.join(tx, unversioned(F.col("gene_id")) == F.col("_g"), "left").drop("_g")


def _overlap(e: Column) -> Column:
    shared = F.least(F.col("exon_end"), e["end"]) - F.greatest(F.col("exon_start"), e["start"])
    return F.greatest(F.lit(0).cast("bigint"), shared)


def best_overlap() -> Column:
    """struct(overlap, neg_index, start, end) of the exon with the largest overlap;
    the lowest start wins a tie.  Null without any overlap."""
    scored = F.transform(
        "tx.exons",
        lambda e, i: F.struct(
            _overlap(e).alias("overlap"), (-i).alias("neg_index"),
            e["start"].alias("start"), e["end"].alias("end"),
        ),
    )
    best = F.array_max(scored)
    return F.when(best["overlap"] > 0, best)


def exon_rank(best: Column | None = None) -> Column:
    """Rank of the best-overlapping exon along the transcript."""
    index = -(best_overlap() if best is None else best)["neg_index"]
    return F.when(
        F.col("tx.strand") == "-", F.size("tx.exons") - index
    ).otherwise(index + 1)


def corrected_boundaries(best: Column | None = None) -> Column:
    """struct(start, end, source) of the model exon standing for the event's exon.

    First the best-overlapping exon if it covers and is covered by at least half;
    else, among the exons between the two flanks, the one closest in size.
    """
    best = best_overlap() if best is None else best
    size = exon_size()
    half = lambda length: (length <= 0) | (best["overlap"] / length >= 0.5)
    by_overlap = F.when(
        half(size) & half(best["end"] - best["start"]),
        F.struct(best["start"].alias("start"), best["end"].alias("end"),
                 F.lit("overlap").alias("source")),
    )
    inside = F.filter(
        "tx.exons",
        lambda e: (e["start"] >= F.col("upstream_ee")) & (e["end"] <= F.col("downstream_es")),
    )
    closest = F.array_min(F.transform(inside, lambda e, i: F.struct(
        F.abs(e["end"] - e["start"] - size).alias("d"), i.alias("i"),
        e["start"].alias("start"), e["end"].alias("end"))))
    by_flanks = F.when(closest.isNotNull(), F.struct(
        closest["start"].alias("start"), closest["end"].alias("end"),
        F.lit("flanking").alias("source")))
    return F.coalesce(by_overlap, by_flanks)


def frame_annotation(mode: str = "span") -> Column:
    """struct(frame_region, frame_class, cds_exon_length) from the caller's exon.

    `span` measures against the coding span (first start to last end); `segments`
    sums the overlap with each merged coding segment, so an exon reaching into a
    gap between segments is partial.
    """
    start, end = F.col("exon_start"), F.col("exon_end")
    cds = merged_intervals(F.col("tx.cds")) if mode == "segments" else F.col("tx.cds")
    lo, hi = F.array_min(F.transform(cds, lambda c: c["start"])), F.array_max(
        F.transform(cds, lambda c: c["end"]))
    if mode == "segments":
        coding = F.aggregate(cds, F.lit(0).cast("bigint"), lambda acc, c: acc + _overlap(c))
        whole = coding >= end - start
    else:
        coding = F.least(end, hi) - F.greatest(start, lo)
        whole = (start >= lo) & (end <= hi)
    plus = F.col("tx.strand") == "+"
    before = end <= lo

    def row(region: Column | str, kind: Column | str, length: Column | None = None) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_col(region).alias("frame_region"), as_col(kind).alias("frame_class"),
            (F.lit(None) if length is None else length).cast("bigint").alias("cds_exon_length"),
        )

    utr = F.when(before == plus, "UTR5").otherwise("UTR3")
    return (
        F.when(F.col("tx").isNull() | start.isNull() | end.isNull(), row("unknown", "unknown"))
        .when(F.size(cds) == 0, row("non_coding", "non_coding"))
        .when(coding <= 0, row(utr, "non_coding"))
        .otherwise(row(
            F.when(whole, "CDS").otherwise("partial"),
            F.when(coding % 3 == 0, "in_frame").otherwise("frameshift"),
            coding,
        ))
    )


def merged_intervals(intervals: Column) -> Column:
    """Union of half-open intervals as a sorted array without overlaps or touching
    neighbours; empty intervals vanish."""
    known = F.array_sort(F.filter(intervals, lambda i: i["end"] > i["start"]))
    none = F.slice(known, 1, 0)

    def fold(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], i["end"]).alias("end"))
        return F.when(
            (F.size(acc) > 0) & (i["start"] <= last["end"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown)),
        ).otherwise(F.concat(acc, F.array(F.struct(
            i["start"].alias("start"), i["end"].alias("end")))))

    return F.aggregate(known, none, fold)


def model_by_position(events: DataFrame, models: DataFrame) -> DataFrame:
    """Gene -> transcript fallback: for events whose gene has no model, the
    transcript overlapping the exon (lowest start, then id, if several)."""
    known = models.select(F.col("gene_id").alias("_g"))
    lost = events.join(
        known, unversioned(F.col("gene_id")) == F.col("_g"), "left_anti"
    ).select("event_id", "chr", "exon_start", "exon_end")
    spans = models.select(
        "chr", "transcript_id",
        F.array_min(F.col("exons.start")).alias("tx_start"),
        F.array_max(F.col("exons.end")).alias("tx_end"),
    )
    hits = overlap_join(lost, spans, "chr", ("exon_start", "exon_end"), ("tx_start", "tx_end"))
    return hits.groupBy("event_id").agg(
        F.min(F.struct("tx_start", "transcript_id"))["transcript_id"].alias("transcript_id")
    )


# -- windows -----------------------------------------------------------------------
def splice_window_sequences(events: DataFrame, genome: Genome) -> DataFrame:
    """One row per event with the five window sequences in transcript orientation.

    Skipped-exon windows use the corrected boundaries (`model_start`/`model_end`)
    where present; flanking windows never do.  `window_truncated` marks events
    whose exon windows were cut by the contig's low end.
    """
    start = F.coalesce("model_start", "exon_start")
    end = F.coalesce("model_end", "exon_end")
    placed = events.where(
        F.col("chr").isNotNull() & F.col("exon_start").isNotNull() & F.col("exon_end").isNotNull()
    )
    named = resolved_contig(
        placed.select("event_id", "chr", "strand", "exon_start", "exon_end", "upstream_ee",
                      "downstream_es", "model_start", "model_end"),
        known_contigs(genome),
    )
    regions = named.select(
        "event_id", "contig", "strand", F.inline(as_long(splice_windows(start, end)))
    ).where(KNOWN)
    found = short_regions(regions, genome)
    oriented = found.select(
        "event_id", "slot", sq.oriented(F.col("seq"), F.col("strand")).alias("seq"),
        (F.col("start") < 0).alias("cut"),
    )
    return oriented.groupBy("event_id").agg(
        *[
            F.max(F.when((F.col("slot") == w) & (F.col("seq") != ""), F.col("seq")))
            .alias(f"{w}_seq")
            for w in WINDOWS
        ],
        F.max(F.col("cut") & F.col("slot").isin("donor", "acceptor", "ppt"))
        .alias("window_truncated"),
    )


# -- feature table --------------------------------------------------------------------
def with_signals(windows: DataFrame) -> DataFrame:
    """Adds everything derived from the window sequences alone."""
    # the branch-point search is staged: eight columns read its one result
    staged = windows.withColumn("_bp", sq.branch_point(F.col("ppt_seq")))
    return staged.withColumns(_signal_columns(F.col("_bp"))).drop("_bp")


def _signal_columns(bp: Column) -> dict[str, Column]:
    donor, acceptor, ppt = F.col("donor_seq"), F.col("acceptor_seq"), F.col("ppt_seq")
    has_ppt = F.length(ppt) > 0
    score = F.when(has_ppt, F.coalesce(bp["score"], F.lit(0)))
    found = F.coalesce(score >= sq.BRANCH_MIN_SCORE, F.lit(False))
    return {
        "donor_is_gt": sq.donor_is_gt(donor),
        "acceptor_is_ag": sq.acceptor_is_ag(acceptor),
        "upstream_donor_is_gt": sq.donor_is_gt(F.col("upstream_donor_seq")),
        "downstream_acceptor_is_ag": sq.acceptor_is_ag(F.col("downstream_acceptor_seq")),
        "ppt_score": F.when(has_ppt, F.round(sq.base_fraction(ppt, "CT"), 4)),
        "ppt_longest_run": F.when(has_ppt, sq.longest_pyrimidine_run(ppt)),
        "bp_motif_found": found,
        "bp_score": score,
        "bp_distance": F.when(found, bp["distance"]),
        "bp_position": F.when(found, bp["position"]),
        "bp_motif": F.when(found, F.substring(F.upper(ppt), bp["position"] + 1, F.lit(7))),
    }


FEATURE_COLUMNS = [
    "event_id", "exon_size", "upstream_intron_size", "downstream_intron_size",
    *[f"{w}_seq" for w in WINDOWS],
    "donor_is_gt", "acceptor_is_ag", "upstream_donor_is_gt", "downstream_acceptor_is_ag",
    "ppt_score", "ppt_longest_run", "bp_motif_found", "bp_distance", "bp_score", "bp_position",
    "bp_motif", "transcript_id", "exon_rank", "frame_region", "frame_class", "cds_exon_length",
    "sequence_source", "model_exon_source", "window_truncated",
]
EVENT_INPUTS = [
    "event_id", "gene_id", "chr", "strand", "exon_start", "exon_end",
    "upstream_ee", "downstream_es",
]


def annotated(events: DataFrame, models: DataFrame) -> DataFrame:
    """Sizes, exon rank, frame class and corrected boundaries: no sequence needed."""
    up, down = intron_sizes()
    # stage by stage, so that each array expression is evaluated once
    best = with_model(events, models).withColumn("_best", best_overlap())
    base = best.withColumns(
        {"_fix": corrected_boundaries(F.col("_best")), "_frame": frame_annotation()}
    )
    return base.withColumns({
        "exon_size": exon_size(),
        "upstream_intron_size": up,
        "downstream_intron_size": down,
        "transcript_id": F.col("tx.transcript_id"),
        "exon_rank": exon_rank(F.col("_best")),
        "frame_region": F.col("_frame.frame_region"),
        "frame_class": F.col("_frame.frame_class"),
        "cds_exon_length": F.col("_frame.cds_exon_length"),
        "model_start": F.col("_fix.start"),
        "model_end": F.col("_fix.end"),
        "model_exon_source": F.col("_fix.source"),
    }).drop("tx", "_best", "_fix", "_frame")


def compute_features(events: DataFrame, models: DataFrame, genome: Genome) -> DataFrame:
    """The feature table: one row per skipped-exon event."""
    se = events.where(F.col("event_type") == "SE").select(*EVENT_INPUTS)
    known = annotated(se, models)
    windows = splice_window_sequences(known, genome)
    joined = known.join(with_signals(windows), "event_id", "left").withColumn(
        "bp_motif_found", F.coalesce("bp_motif_found", F.lit(False)))
    return joined.withColumns({
        "sequence_source": F.when(F.col("donor_seq").isNotNull(), F.lit("fasta")),
    }).select(*FEATURE_COLUMNS)


def events_with_features(events: DataFrame, features: DataFrame) -> DataFrame:
    """Skipped-exon events left-joined to their features; `has_features` tells a
    missing feature row from one full of nulls."""
    se = events.where(F.col("event_type") == "SE")
    return se.join(features.withColumn("has_features", F.lit(True)), "event_id", "left").withColumn(
        "has_features", F.coalesce("has_features", F.lit(False))
    )


def completeness(events: DataFrame, features: DataFrame) -> DataFrame:
    """One row: skipped-exon events, how many have features, and the percentage."""
    return events_with_features(
        events.select("event_id", "event_type"), features.select("event_id")
    ).agg(
        F.count(F.lit(1)).alias("n_se_events"),
        F.count_if("has_features").alias("n_computed"),
    ).withColumn(
        "pct",
        F.when(F.col("n_se_events") > 0, F.round(
            F.col("n_computed") / F.col("n_se_events") * 100, 1)).otherwise(F.lit(0.0)),
    )


def feature_of_event(events: DataFrame, features: DataFrame, event_id) -> DataFrame:
    """Point lookup; an event of another type yields an explanatory error row."""
    one = events.where(F.col("event_id") == event_id).select(
        "event_id", "event_type", "gene_symbol")
    return one.join(features, "event_id", "left").withColumn(
        "error",
        F.when(F.col("event_type") != "SE", "Splice site analysis only available for SE events"),
    )
