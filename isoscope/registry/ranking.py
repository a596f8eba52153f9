"""Registered queries: pages, top lists, genome plot."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.functions.catalogue import CHROMOSOME_MB, PLOT_GAP
from isoscope.operators import ranking as rk
from isoscope.registry import fixtures as fx
from isoscope.registry.fixtures import SIG

R = fx.Registry()
query = R.query

_RANK = "CASE substr(chr, 4) WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 ELSE TRY_CAST(substr(chr, 4) AS integer) END"


@query("i1_event_page", "SELECT event_id, gene_symbol, fdr, inc_level_difference FROM splice_events WHERE event_type = 'SE' ORDER BY abs(inc_level_difference) DESC NULLS LAST, event_id LIMIT 50 OFFSET 100")
def i1(spark, sf):
    page = rk.page_of(fx.skipped(spark, sf), "abs_inc_level_diff", True, page=3)
    return page.select("event_id", "gene_symbol", "fdr", "inc_level_difference")


@query("i1_keyset_page", "SELECT event_id, gene_symbol, fdr, inc_level_difference FROM splice_events WHERE event_type = 'SE' ORDER BY abs(inc_level_difference) DESC NULLS LAST, event_id LIMIT 50 OFFSET 100")
def i1_keyset(spark, sf):
    """The same page behind its border instead of by an offset."""
    rows = fx.skipped(spark, sf)
    borders = rk.page_borders(rows, "abs_inc_level_diff", True)
    found = borders.where("page = 3").first()  # one row: the border of the page asked for
    page = rk.page_after(rows, found.asDict(), "abs_inc_level_diff", True)
    return page.select("event_id", "gene_symbol", "fdr", "inc_level_difference")


@query("i1_page_count", "SELECT count(*) AS total, cast(greatest(1, ceil(count(*) / 50.0)) AS bigint) AS pages FROM se")
def i1_count(spark, sf):
    return rk.page_count(fx.skipped(spark, sf))


@query("i2_deep_analysis_page", f"SELECT event_id, fdr FROM splice_events WHERE {SIG} ORDER BY fdr NULLS LAST, event_id LIMIT 40 OFFSET 40")
def i2(spark, sf):
    from isoscope.operators.significance import deep_analysis_events

    mine = deep_analysis_events(fx.events(spark, sf), fx.tags(spark, sf), fx.DEEP, True)
    return rk.page_of(mine, "fdr", page=2, page_size=40).select("event_id", "fdr")


# a budget that every scale exceeds, so that the sampling branch runs
_BUDGET = """, strong AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE fdr < 0.05) AS n_strong FROM splice_events),
step AS (SELECT greatest(1, (n_all - n_strong) // (cast(n_strong + n_all // 20 AS bigint) - n_strong)) AS s FROM strong),
numbered AS (SELECT *, row_number() OVER (ORDER BY {rank}, exon_start, event_id) AS rn FROM splice_events WHERE fdr IS NULL OR fdr >= 0.05),
plot AS (SELECT event_id, event_type, gene_symbol, chr, exon_start, fdr, inc_level_difference FROM splice_events WHERE fdr < 0.05
  UNION ALL SELECT event_id, event_type, gene_symbol, chr, exon_start, fdr, inc_level_difference FROM numbered WHERE rn % (SELECT s FROM step) = 0)
""".format(rank=_RANK)


def _plot(spark, sf):
    ev = fx.events(spark, sf)
    n = ev.agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("fdr") < 0.05).alias("s")).first()
    return rk.plot_set(ev, n["s"] + n["a"] // 20)


@query("i3_genome_plot_set", _BUDGET + "SELECT * FROM plot")
def i3(spark, sf):
    return _plot(spark, sf)


@query("i3_small_plot_set", "SELECT event_id, chr, exon_start, fdr FROM splice_events WHERE event_type = 'RI'")
def i3_small(spark, sf):
    rows = fx.events(spark, sf).where("event_type = 'RI'")
    # a budget that holds all rows at any scale
    return rk.plot_set(rows, rows.count()).select("event_id", "chr", "exon_start", "fdr")


@query("i4_genome_order", f"SELECT event_id, row_number() OVER (ORDER BY {_RANK}, exon_start, event_id) AS rn FROM splice_events")
def i4(spark, sf):
    from isoscope.plans.prefix import row_numbers

    # the order's own columns: the numbered rows are written once
    keyed = fx.events(spark, sf).select("event_id", "chr", "exon_start")
    numbered = row_numbers(keyed, rk.genome_order(), "rn")
    return rk.in_genome_order(numbered).select("event_id", "rn")


@query("i5_top_skipped_exons", """SELECT event_id, gene_symbol, chr, strand, exon_size, fdr, inc_level_difference, CASE WHEN donor_is_gt IS NULL THEN '?' WHEN donor_is_gt THEN 'GT' ELSE '!GT' END || '/' ||
  CASE WHEN acceptor_is_ag IS NULL THEN '?' WHEN acceptor_is_ag THEN 'AG' ELSE '!AG' END AS site_label, frame_class FROM joined WHERE sig AND fdr IS NOT NULL ORDER BY fdr, abs(inc_level_difference) DESC, event_id LIMIT 20""")
def i5(spark, sf):
    return rk.top_skipped_exons(fx.joined(spark, sf).where("is_significant"))


@query("i6_flank_corrected", "SELECT event_id, gene_symbol, chr, strand, exon_start, exon_end, transcript_id FROM joined WHERE model_exon_source = 'flanking' ORDER BY gene_symbol, chr, exon_start, event_id LIMIT 30")
def i6(spark, sf):
    return rk.flank_corrected_shown(fx.joined(spark, sf))


@query("i6_flank_corrected_count", "SELECT count(*) AS n_events, greatest(0, count(*) - 30) AS n_not_shown FROM joined WHERE model_exon_source = 'flanking'")
def i6_count(spark, sf):
    return rk.flank_corrected_count(fx.joined(spark, sf))


_MB = ", ".join(f"({i}, '{c}', {float(mb)})" for i, (c, mb) in enumerate(CHROMOSOME_MB.items()))
COORDS = f""", mb(ord, chrom, mb) AS (VALUES {_MB}), present AS (SELECT DISTINCT substr(chr, 4) AS chrom FROM splice_events),
offs AS (SELECT chrom, coalesce(sum(mb + {PLOT_GAP}) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_mb FROM mb JOIN present USING (chrom)),
xy AS (SELECT event_id, event_type, gene_symbol, chrom, exon_start, cast(offset_mb AS double) + exon_start / cast(1000000 AS double) AS x, -log10(fdr) AS y FROM splice_events JOIN offs ON chrom = substr(chr, 4) WHERE fdr > 0)
"""


@query("e22_plot_coordinates", COORDS + "SELECT event_id, chrom, round(x, 6) AS x, round(y, 6) AS y FROM xy")
def e22(spark, sf):
    return rk.plot_coordinates(fx.events(spark, sf)).select(
        "event_id", "chrom", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("i7_top_labels", COORDS + """, best AS (SELECT upper(gene_symbol) AS symbol, event_id, y, row_number() OVER (PARTITION BY upper(gene_symbol) ORDER BY y DESC, event_id) AS rn FROM xy WHERE y > 1.3)
SELECT symbol, event_id, round(y, 6) AS y FROM best WHERE rn = 1 ORDER BY y DESC, event_id LIMIT 5""")
def i7(spark, sf):
    return rk.top_labels(rk.plot_coordinates(fx.events(spark, sf)), 1.3).withColumn(
        "y", F.round("y", 6))


_CARD_SQL = {
    "fdr": "coalesce(fdr, 1)", "p_value": "coalesce(p_value, 1)",
    "effect": "coalesce(abs(inc_level_difference), 0) DESC",
    "chr": f"{_RANK}, exon_start", "panel": "panel_level DESC, coalesce(fdr, 1)",
}


def _card(key: str) -> None:
    @query(f"i8_card_order_{key}", f", cards AS (SELECT *, event_id % 4 AS panel_level FROM splice_events) SELECT event_id, gene_symbol, row_number() OVER (ORDER BY {_CARD_SQL[key]}, gene_symbol, event_id) AS position FROM cards")
    def run(spark, sf):
        ev = fx.events(spark, sf).withColumn("panel_level", F.col("event_id") % 4)
        return rk.card_positions(ev, key).select("event_id", "gene_symbol", "position")


for _key in _CARD_SQL:
    _card(_key)


@query("i15_newest_first", "SELECT o_orderkey AS id, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS position FROM orders", prefix=False)
def i15(spark, sf):
    records = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS id", "o_orderdate AS created_at")
    return rk.newest_positions(records)


