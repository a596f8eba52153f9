"""Pages, top lists and the genome-wide plot set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoscope.functions.catalogue import CHROMOSOME_MB, PLOT_GAP
from isoscope.functions.genome_order import bare_name, chromosome_key, display_rank
from isoscope.functions.labels import site_label
from isoscope.plans.lineage import materialize
from isoscope.plans.prefix import row_numbers

PLOT_MAX_POINTS = 50_000
PLOT_FDR = 0.05
SORTABLE = ("fdr", "p_value", "abs_inc_level_diff", "gene_symbol")
PLOT_COLUMNS = [
    "event_id", "event_type", "gene_symbol", "chr", "exon_start", "fdr", "inc_level_difference",
]


# -- pages ------------------------------------------------------------------------
def _sort_value(name: str) -> Column:
    if name not in SORTABLE:
        raise ValueError(f"cannot sort by {name}")
    return F.abs("inc_level_difference") if name == "abs_inc_level_diff" else F.col(name)


def page_of(
    events: DataFrame, sort_by: str = "fdr", descending: bool = False,
    page: int = 1, page_size: int = 50,
) -> DataFrame:
    """One page; nulls last both ways, event id breaks ties."""
    value = _sort_value(sort_by)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return events.orderBy(order, "event_id").offset((page - 1) * page_size).limit(page_size)


def page_borders(
    events: DataFrame, sort_by: str = "fdr", descending: bool = False, page_size: int = 50,
) -> DataFrame:
    """(page, value, event_id): the last row before each page but the first, in the order of
    `page_of`.  One small row per page, numbered without a global window; made once for a
    stored table, it lets any page be read by `page_after`."""
    value = _sort_value(sort_by)
    keyed = events.select(value.alias("value"), "event_id")
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    numbered = row_numbers(keyed, [order, F.col("event_id")], "_rn")
    return numbered.where(F.col("_rn") % page_size == 0).select(
        (F.col("_rn") / page_size + 1).cast("bigint").alias("page"), "value", "event_id")


def page_after(
    events: DataFrame, border: dict | None, sort_by: str = "fdr", descending: bool = False,
    page_size: int = 50,
) -> DataFrame:
    """The page behind a border (`value`, `event_id`; None: the first page).  Earlier rows fail
    a predicate on the sort columns, which reaches the scan, instead of being sorted and
    skipped."""
    value = _sort_value(sort_by)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    if border is not None:
        later = F.col("event_id") > F.lit(border["event_id"])
        if border["value"] is None:
            behind = value.isNull() & later
        else:
            at = F.lit(border["value"])
            behind = (value < at if descending else value > at) | value.isNull() | ((value == at) & later)
        events = events.where(behind)
    return events.orderBy(order, "event_id").limit(page_size)


def page_count(events: DataFrame, page_size: int = 50) -> DataFrame:
    """One row: total and number of pages (at least one)."""
    total = F.count(F.lit(1))
    return events.agg(
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / page_size)).cast("bigint").alias("pages"),
    )


def top_skipped_exons(joined: DataFrame, n: int = 20) -> DataFrame:
    """Best events by FDR, then effect size."""
    return (
        joined.where((F.col("event_type") == "SE") & F.col("fdr").isNotNull())
        .orderBy("fdr", F.desc(F.abs(F.coalesce("inc_level_difference", F.lit(0.0)))), "event_id")
        .limit(n)
        .select(
            "event_id", "gene_symbol", "chr", "strand", "exon_size", "fdr",
            "inc_level_difference",
            site_label(F.col("donor_is_gt"), F.col("acceptor_is_ag")).alias("site_label"),
            "frame_class",
        )
    )


def flank_corrected(joined: DataFrame) -> DataFrame:
    return joined.where((F.col("event_type") == "SE") & (F.col("model_exon_source") == "flanking"))


def flank_corrected_shown(joined: DataFrame, n: int = 30) -> DataFrame:
    """Events whose exon was corrected by its flanks, in gene and genome order."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (
        flank_corrected(joined)
        .orderBy(blank("gene_symbol"), blank("chr"), F.coalesce("exon_start", F.lit(0)), "event_id")
        .limit(n)
        .select("event_id", "gene_symbol", "chr", "strand", "exon_start", "exon_end",
                "transcript_id")
    )


def flank_corrected_count(joined: DataFrame, n: int = 30) -> DataFrame:
    return flank_corrected(joined).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("n_not_shown"))


CARD_ORDERS = {
    "fdr": lambda: [F.coalesce("fdr", F.lit(1.0))],
    "p_value": lambda: [F.coalesce("p_value", F.lit(1.0))],
    "effect": lambda: [F.desc(F.coalesce(F.abs("inc_level_difference"), F.lit(0.0)))],
    "chr": lambda: [display_rank(F.col("chr")), F.coalesce("exon_start", F.lit(0))],
    "panel": lambda: [F.desc(F.coalesce("panel_level", F.lit(0))), F.coalesce("fdr", F.lit(1.0))],
}


def _card_columns(key: str) -> list[Column]:
    return [*CARD_ORDERS[key](), F.coalesce("gene_symbol", F.lit("")), F.col("event_id")]


def card_order(events: DataFrame, key: str) -> DataFrame:
    """Display order of event cards; ties by symbol, then id.  `panel` needs a
    `panel_level` column."""
    return events.orderBy(*_card_columns(key))


def card_positions(events: DataFrame, key: str, name: str = "position") -> DataFrame:
    """All cards with their 1-based place in display order."""
    return row_numbers(events, _card_columns(key), name)


def newest_first(records: DataFrame, key: str = "id") -> DataFrame:
    return records.orderBy(F.desc_nulls_last("created_at"), key)


def newest_positions(records: DataFrame, key: str = "id", name: str = "position") -> DataFrame:
    """All records with their 1-based place, newest first."""
    return row_numbers(records, [F.desc_nulls_last("created_at"), F.col(key)], name)


def top_permutation(results: DataFrame, n: int = 15) -> DataFrame:
    return results.where("empirical_p_value IS NOT NULL").orderBy(
        "empirical_p_value", "event_id").limit(n)


# -- genome-wide plot --------------------------------------------------------------
def genome_order() -> list[Column]:
    rank, name = chromosome_key(F.col("chr"))
    return [rank, name, F.col("exon_start"), F.col("event_id")]


def in_genome_order(events: DataFrame) -> DataFrame:
    return events.orderBy(*genome_order())


def plot_set(events: DataFrame, max_points: int = PLOT_MAX_POINTS) -> DataFrame:
    """Points of the genome plot, in genome order: everything while it fits, else every
    significant event plus every N-th other one along the genome.  N is rounded down, so
    the budget may be exceeded."""
    rank, name = chromosome_key(F.col("chr"))
    # the points and their sort keys are computed once; counts, numbering and sorts read them
    placed = materialize(events.where(F.col("chr").isNotNull() & F.col("exon_start").isNotNull()).select(
        *PLOT_COLUMNS, rank.alias("_rank"), name.alias("_name")), "plot-points")
    order = [F.col(c) for c in ("_rank", "_name", "exon_start", "event_id")]
    strong = F.coalesce(F.col("fdr") < PLOT_FDR, F.lit(False))
    n = placed.agg(F.count(F.lit(1)).alias("all"), F.count_if(strong).alias("strong")).first()
    budget = max(0, max_points - n["strong"])
    if n["all"] <= max_points:
        chosen = placed
    elif budget == 0:
        chosen = placed.where(strong)
    else:
        step = max(1, (n["all"] - n["strong"]) // budget)
        numbered = row_numbers(placed.where(~strong), order, "_rn")
        chosen = placed.where(strong).unionByName(numbered.where(F.col("_rn") % step == 0).drop("_rn"))
    return chosen.orderBy(*order).select(*PLOT_COLUMNS)


def chromosome_offsets(points: DataFrame) -> DataFrame:
    """Cumulative start (Mb) of every plotted chromosome that is present.

    A running total over at most 24 names."""
    from pyspark.sql import Window

    sizes = points.sparkSession.createDataFrame(
        [(i, c, float(mb)) for i, (c, mb) in enumerate(CHROMOSOME_MB.items())],
        "ord int, chrom string, mb double")
    present = points.select(bare_name(F.col("chr")).alias("chrom")).distinct()
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.join(present, "chrom", "left_semi")
    return kept.select(
        "chrom",
        F.coalesce(F.sum(F.col("mb") + PLOT_GAP).over(before), F.lit(0.0)).alias("offset_mb"))


def plot_coordinates(points: DataFrame) -> DataFrame:
    """x in Mb along the genome and y = -log10(FDR).  A null or zero FDR has no
    height, a chromosome outside the layout no place."""
    offsets = chromosome_offsets(points)
    drawn = points.where(F.col("fdr") > 0).withColumn("chrom", bare_name(F.col("chr")))
    return drawn.join(offsets, "chrom").select(
        "event_id", "event_type", "gene_symbol", "chrom", "exon_start",
        (F.col("offset_mb") + F.col("exon_start") / F.lit(1e6)).alias("x"),
        (-F.log10("fdr")).alias("y"),
    )


def top_labels(coordinates: DataFrame, min_y: float, n: int = 5) -> DataFrame:
    """The highest point of each of the n best genes (symbols compared upper-case)."""
    best = (
        coordinates.where((F.col("gene_symbol") != "") & (F.col("y") > min_y))
        .groupBy(F.upper("gene_symbol").alias("symbol"))
        .agg(F.min(F.struct((-F.col("y")).alias("neg_y"), "event_id")).alias("b"))
    )
    return best.select("symbol", F.col("b.event_id").alias("event_id"),
                       (-F.col("b.neg_y")).alias("y")).orderBy(F.desc("y"), "event_id").limit(n)


def gene_markers(events: DataFrame, symbols: list[str]) -> DataFrame:
    """Per candidate gene: the chromosome with most events, the upper-middle position
    on it, and the number of events there.  Positions are first counted per distinct
    value, so a gene with very many events stays small."""
    from pyspark.sql import Window

    wanted = [s.upper() for s in symbols]
    counted = (
        events.where(F.upper("gene_symbol").isin(*wanted) & F.col("chr").isNotNull()
                     & F.col("exon_start").isNotNull())
        .groupBy(F.upper("gene_symbol").alias("symbol"), bare_name(F.col("chr")).alias("chrom"),
                 F.col("exon_start").alias("pos"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_chrom = counted.groupBy("symbol", "chrom").agg(F.sum("n").alias("n_events"))
    best = per_chrom.groupBy("symbol").agg(
        F.min(F.struct((-F.col("n_events")).alias("neg"), "chrom"))["chrom"].alias("chrom"))
    w = Window.partitionBy("symbol", "chrom")
    running = counted.join(best, ["symbol", "chrom"]).withColumns({
        "_upto": F.sum("n").over(w.orderBy("pos")), "n_events": F.sum("n").over(w)})
    # zero-based index floor(n / 2) of the sorted positions
    return running.where(F.col("_upto") > F.floor(F.col("n_events") / 2)).groupBy(
        "symbol", "chrom", "n_events").agg(F.min("pos").alias("position"))
