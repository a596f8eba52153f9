"""Registered queries: projections, filters, de-duplication."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from isoscope.functions import cells
from isoscope.functions.coordinates import exon_size, intron_sizes
from isoscope.operators import coverage, dedup, ingest, significance
from isoscope.operators import features as ft
from isoscope.registry import fixtures as fx
from isoscope.registry.fixtures import EFFECT, FDR, SIG

R = fx.Registry()
query = R.query

# counts: 'NA' and friends are null, blanks vanish
_COUNTS = ("list_transform(list_filter(list_transform(string_split({0}, ','), lambda t: trim(t)), lambda t: t <> ''),"
           " lambda t: CAST(trunc(TRY_CAST(t AS double)) AS bigint))")
_PSI = ("list_filter(list_transform(string_split({0}, ','), lambda t: TRY_CAST(trim(t) AS double)),"
        " lambda v: v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND v <= 1)")
_PAIR = ("list_avg(list_filter(list_transform(range(1, least(len({0}), len({1})) + 1), lambda i: ({0})[i] + ({1})[i]),"
         " lambda v: v IS NOT NULL))")
COVERAGE = ", coverage AS (SELECT *, " + _PAIR.format(
    _COUNTS.format("ijc_sample_1"), _COUNTS.format("sjc_sample_1")) + " AS c1, " + _PAIR.format(
    _COUNTS.format("ijc_sample_2"), _COUNTS.format("sjc_sample_2")) + " AS c2 FROM splice_events)\n"


@query("b1_count_list", "SELECT event_id, array_to_string(list_transform("
       + _COUNTS.format("concat(' ', ijc_sample_1, ',,', sjc_sample_2, ',1.9')")
       + ", lambda v: coalesce(cast(v AS varchar), 'null')), '|') AS counts FROM splice_events")
def b1(spark, sf):
    text = F.concat(F.lit(" "), "ijc_sample_1", F.lit(",,"), "sjc_sample_2", F.lit(",1.9"))
    return fx.events(spark, sf).select(
        "event_id",
        F.array_join(F.transform(
            cells.count_list(text), lambda v: F.coalesce(v.cast("string"), F.lit("null"))), "|")
        .alias("counts"))


@query("b2_coverage_filter", COVERAGE + "SELECT event_id, event_type, round(c1, 6) AS coverage_1, round(c2, 6) AS coverage_2 FROM coverage WHERE c1 >= 10 AND c2 >= 10")
def b2(spark, sf):
    one, two = coverage.group_coverage()
    return coverage.filter_low_coverage(fx.events(spark, sf)).select(
        "event_id", "event_type", F.round(one, 6).alias("coverage_1"),
        F.round(two, 6).alias("coverage_2"))


@query("b3_drop_accounting", COVERAGE + """SELECT count(*) AS n_total,
  count(*) FILTER (WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND (c1 < 10 OR c2 < 10)) AS n_low,
  count(*) FILTER (WHERE c1 IS NULL OR c2 IS NULL) AS n_missing,
  count(*) FILTER (WHERE c1 >= 10 AND c2 >= 10) AS n_kept FROM coverage""")
def b3(spark, sf):
    return coverage.drop_accounting(fx.events(spark, sf))


@query("b4_event_list_filter", """SELECT event_id, event_type, gene_symbol, fdr FROM splice_events
  WHERE event_type = 'SE' AND gene_symbol ILIKE '%ene1_%' AND fdr <= 0.08 AND p_value <= 0.03 AND abs(inc_level_difference) >= 0.2""")
def b4(spark, sf):
    return significance.filter_events(
        fx.events(spark, sf), event_type="se", gene_symbol="ene1_", fdr_max=0.08,
        p_value_max=0.03, effect_min=0.2,
    ).select("event_id", "event_type", "gene_symbol", "fdr")


@query("b5_significant_events", f"SELECT event_id, event_type, fdr, p_value, inc_level_difference FROM splice_events WHERE {SIG} AND p_value <= {fx.P_MAX}")
def b5(spark, sf):
    return fx.events(spark, sf).where(
        significance.is_significant(FDR, EFFECT, fx.P_MAX)
    ).select("event_id", "event_type", "fdr", "p_value", "inc_level_difference")


@query("b6_tag_events", f"SELECT '{fx.DEEP}' AS deep_analysis_id, event_id, {SIG} AS is_significant FROM splice_events")
def b6(spark, sf):
    return fx.tags(spark, sf)


@query("b6_tag_counts", f"SELECT '{fx.DEEP}' AS deep_analysis_id, count(*) FILTER (WHERE {SIG}) AS n_significant, count(*) FILTER (WHERE NOT {SIG}) AS n_not_significant FROM splice_events")
def b6_counts(spark, sf):
    return significance.tag_counts(fx.tags(spark, sf))


@query("b7_skipped_exons_only", "SELECT event_id, gene_id FROM splice_events WHERE event_type = 'SE'")
def b7(spark, sf):
    return fx.skipped(spark, sf).select("event_id", "gene_id")


@query("b8_psi_list", "SELECT event_id, array_to_string(list_transform("
       + _PSI.format("concat(inc_level_1, ',1.5,nan, ', inc_level_2, ',-0.1')")
       + ", lambda v: cast(cast(round(v * 1000) AS bigint) AS varchar)), '|') AS psi FROM splice_events")
def b8(spark, sf):
    text = F.concat("inc_level_1", F.lit(",1.5,nan, "), "inc_level_2", F.lit(",-0.1"))
    return fx.events(spark, sf).select("event_id", F.array_join(F.transform(
        cells.psi_list(text), lambda v: F.round(v * 1000).cast("bigint").cast("string")), "|")
        .alias("psi"))


@query("b9_display_mean_psi", """SELECT event_id,
  round(list_avg(list_filter(list_transform(string_split(inc_level_1, ','), lambda t: TRY_CAST(t AS double)), lambda v: v IS NOT NULL)), 6) AS mean_1,
  round(list_avg(list_filter(list_transform(string_split(concat(inc_level_2, ',1.5'), ','), lambda t: TRY_CAST(t AS double)), lambda v: v IS NOT NULL)), 6) AS mean_2
  FROM splice_events""")
def b9(spark, sf):
    return fx.events(spark, sf).select(
        "event_id",
        F.round(cells.display_mean_psi(F.col("inc_level_1")), 6).alias("mean_1"),
        F.round(cells.display_mean_psi(F.concat("inc_level_2", F.lit(",1.5"))), 6).alias("mean_2"))


@query("b10_exon_size", "SELECT event_id, exon_end - exon_start AS exon_size FROM se")
def b10(spark, sf):
    return fx.skipped(spark, sf).select("event_id", exon_size().alias("exon_size"))


@query("b11_intron_sizes", "SELECT event_id, upstream_intron_size, downstream_intron_size FROM sizes")
def b11(spark, sf):
    up, down = intron_sizes()
    return fx.skipped(spark, sf).select(
        "event_id", up.alias("upstream_intron_size"), down.alias("downstream_intron_size"))


@query("b12_feature_completeness", """SELECT count(*) AS n_se_events, count(*) FILTER (WHERE event_id % 7 <> 0) AS n_computed,
  round(count(*) FILTER (WHERE event_id % 7 <> 0) / cast(count(*) AS double) * 100, 1) AS pct FROM se""")
def b12(spark, sf):
    computed = fx.skipped(spark, sf).where("event_id % 7 <> 0").select("event_id")
    return ft.completeness(fx.events(spark, sf), computed)


@query("b13_deep_analysis_name", """, s AS (SELECT 'AN' || cast(g % 20 AS varchar) AS analysis_id, list('GENE' || cast(g AS varchar) ORDER BY g) AS syms FROM genes WHERE g % 20 <> 7 GROUP BY 1)
SELECT analysis_id, array_to_string(syms[1:3], '_') || '-FDR0.05-PSI0.1-p0.02-2026-01-02' AS name FROM s""")
def b13(spark, sf):
    analyses = fx.genes(spark, sf).where("g % 20 <> 7").selectExpr(
        "concat('AN', cast(g % 20 AS string)) AS analysis_id",
        "g", "concat('GENE', cast(g AS string)) AS symbol",
    ).groupBy("analysis_id").agg(
        F.expr("transform(array_sort(collect_list(struct(g, symbol))), s -> struct(s.symbol AS symbol))")
        .alias("candidate_genes"))
    return significance.deep_analysis_name(
        analyses, FDR, EFFECT, fx.P_MAX, dt.date(2026, 1, 2)).select("analysis_id", "name")


@query("b14_feature_of_event", """SELECT e.event_id, e.event_type, e.gene_symbol, f.donor_seq, f.ppt_score, f.frame_class,
  CASE WHEN e.event_type <> 'SE' THEN 'Splice site analysis only available for SE events' END AS error
  FROM splice_events e LEFT JOIN features f USING (event_id) WHERE e.event_id IN (SELECT max(event_id) FROM se)""")
def b14(spark, sf):
    wanted = fx.skipped(spark, sf).agg(F.max("event_id")).first()[0]
    found = ft.feature_of_event(fx.events(spark, sf), fx.features(spark, sf), wanted)
    return found.select("event_id", "event_type", "gene_symbol", "donor_seq", "ppt_score",
                        "frame_class", "error")


@query("b14_feature_of_other_type", """SELECT event_id, event_type, CASE WHEN event_type <> 'SE' THEN 'Splice site analysis only available for SE events' END AS error
  FROM splice_events WHERE event_id IN (SELECT max(event_id) FROM splice_events WHERE event_type = 'MXE')""")
def b14_other(spark, sf):
    wanted = fx.events(spark, sf).where("event_type = 'MXE'").agg(F.max("event_id")).first()[0]
    features = fx.skipped(spark, sf).select("event_id", exon_size().alias("exon_size"))
    return ft.feature_of_event(fx.events(spark, sf), features, wanted).select(
        "event_id", "event_type", "error")


@query("b15_rows_of_analysis", "SELECT event_id, 'AN' || cast(event_id % 4 AS varchar) AS analysis_id FROM splice_events WHERE event_id % 4 = 2")
def b15(spark, sf):
    return fx.events(spark, sf).selectExpr(
        "event_id", "concat('AN', cast(event_id % 4 AS string)) AS analysis_id"
    ).where("analysis_id = 'AN2'")


# -- de-duplication ---------------------------------------------------------------------
_ORDER = "ORDER BY fdr NULLS LAST, abs(inc_level_difference) DESC NULLS LAST, event_id"


def _greedy(kind: str, near: str, source: str = "splice_events") -> str:
    return f""", {kind.lower()}_groups AS (SELECT list([{{'id': event_id, 's': exon_start, 'e': exon_end, 's2': second_exon_start, 'e2': second_exon_end}}] {_ORDER}) AS rows_
    FROM {source} WHERE event_type = '{kind}' GROUP BY gene_id, chr, strand),
  {kind.lower()}_kept AS (SELECT unnest(list_reduce(rows_, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: {near})) > 0 THEN kept ELSE list_concat(kept, x) END)).id AS event_id FROM {kind.lower()}_groups)
"""


def _d(a: str) -> str:
    return f"abs(y.{a} - x[1].{a}) <= 50"


SE_NEAR = f"{_d('s')} OR {_d('e')}"
RI_NEAR = f"{_d('s')} AND {_d('e')}"
MXE_NEAR = f"{_d('s')} AND {_d('e')} AND {_d('s2')} AND {_d('e2')}"
ALT_KEYS = "event_type, gene_id, chr, strand, long_exon_start, long_exon_end, short_es, short_ee, flanking_es, flanking_ee"


def _alt(source: str = "splice_events") -> str:
    return f""", alt_kept AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY {ALT_KEYS} {_ORDER}) AS rn
    FROM {source} WHERE event_type IN ('A3SS', 'A5SS')) x WHERE rn = 1)
"""


def _of_type(kind):
    def run(spark, sf):
        return dedup.deduplicate(fx.events(spark, sf).where(F.col("event_type") == kind)).select(
            "event_id", "event_type")

    return run


for _id, _kind, _near in (
    ("c1_dedup_se", "SE", SE_NEAR), ("c2_dedup_ri", "RI", RI_NEAR), ("c3_dedup_mxe", "MXE", MXE_NEAR),
):
    query(_id, _greedy(_kind, _near)
          + f"SELECT event_id, '{_kind}' AS event_type FROM {_kind.lower()}_kept")(_of_type(_kind))


def _crowded(spark, sf):
    """Near-duplicates planted around every exclusive and retained exon, so that the
    AND rules really collapse rows."""
    shifted = F.explode(F.array(F.lit(0), F.lit(7), F.lit(40), F.lit(51)))
    ev = fx.events(spark, sf).where("event_type IN ('RI', 'MXE', 'A3SS')").withColumn("d", shifted)
    cols = ["exon_start", "exon_end", "second_exon_start", "second_exon_end"]
    return ev.withColumns(
        {c: F.col(c) + F.col("d") for c in cols}
        | {"event_id": F.col("event_id") * 100 + F.col("d"),
           "fdr": F.col("fdr") + F.col("d") % 5}
    ).drop("d")


_CROWDED = """, crowded AS (SELECT e.* REPLACE (exon_start + d AS exon_start, exon_end + d AS exon_end, second_exon_start + d AS second_exon_start,
    second_exon_end + d AS second_exon_end, event_id * 100 + d AS event_id, fdr + d % 5 AS fdr)
  FROM splice_events e CROSS JOIN (SELECT unnest([0, 7, 40, 51]) AS d) s WHERE event_type IN ('RI', 'MXE', 'A3SS'))
"""


@query("c2_dedup_crowded", _CROWDED + _greedy("RI", RI_NEAR, "crowded") + _greedy("MXE", MXE_NEAR, "crowded") + _alt("crowded")
       + "SELECT event_id, 'RI' AS event_type FROM ri_kept UNION ALL SELECT event_id, 'MXE' FROM mxe_kept UNION ALL SELECT event_id, 'A3SS' FROM alt_kept")
def c2_crowded(spark, sf):
    return dedup.deduplicate(_crowded(spark, sf)).select("event_id", "event_type")


@query("c4_dedup_alt_sites", _alt() + "SELECT event_id, event_type FROM splice_events JOIN alt_kept USING (event_id)")
def c4(spark, sf):
    alt = fx.events(spark, sf).where("event_type IN ('A3SS', 'A5SS')")
    return dedup.deduplicate(alt).select("event_id", "event_type")


ALL_KEPT = (_greedy("SE", SE_NEAR) + _greedy("RI", RI_NEAR) + _greedy("MXE", MXE_NEAR) + _alt()
            + ", all_kept AS (SELECT event_id FROM se_kept UNION ALL SELECT event_id FROM ri_kept UNION ALL SELECT event_id FROM mxe_kept UNION ALL SELECT event_id FROM alt_kept)\n")


@query("c5_dedup_all_types", ALL_KEPT + "SELECT event_id, event_type, gene_id, fdr FROM splice_events JOIN all_kept USING (event_id)")
def c5(spark, sf):
    return dedup.deduplicate(fx.events(spark, sf)).select("event_id", "event_type", "gene_id", "fdr")


@query("c5_collapsed_by_type", ALL_KEPT + """SELECT event_type, count(*) AS n_before, count(k.event_id) AS n_after, count(*) - count(k.event_id) AS n_collapsed
  FROM splice_events e LEFT JOIN all_kept k USING (event_id) GROUP BY event_type""")
def c5_counts(spark, sf):
    events = fx.events(spark, sf)
    return dedup.collapsed_by_type(events, dedup.deduplicate(events))


_TWO_MODES = """, two_modes AS (SELECT * REPLACE (event_id * 2 AS event_id, 'JC' AS counting_mode) FROM splice_events UNION ALL
  SELECT * REPLACE (event_id * 2 + 1 AS event_id, 'JCEC' AS counting_mode, CASE WHEN event_id % 2 = 0 THEN fdr / 2 ELSE fdr * 1.5 END AS fdr) FROM splice_events)
"""


@query("c6_merge_counting_modes", _TWO_MODES + _greedy("SE", SE_NEAR, "two_modes") + _greedy("RI", RI_NEAR, "two_modes") + _greedy("MXE", MXE_NEAR, "two_modes") + _alt("two_modes")
       + "SELECT event_id, counting_mode FROM two_modes JOIN (SELECT event_id FROM se_kept UNION ALL SELECT event_id FROM ri_kept UNION ALL SELECT event_id FROM mxe_kept UNION ALL SELECT event_id FROM alt_kept) k USING (event_id)")
def c6(spark, sf):
    ev = fx.events(spark, sf)
    jc = ev.withColumns({"event_id": F.col("event_id") * 2, "counting_mode": F.lit("JC")})
    jcec = ev.withColumns({
        "fdr": F.when(F.col("event_id") % 2 == 0, F.col("fdr") / 2).otherwise(F.col("fdr") * 1.5),
        "event_id": F.col("event_id") * 2 + 1, "counting_mode": F.lit("JCEC")})
    return dedup.deduplicate(jc.unionByName(jcec)).select("event_id", "counting_mode")


_IDENTITY = ("event_type, gene_id, chr, strand, exon_start, exon_end, upstream_es, upstream_ee, downstream_es, downstream_ee, "
             "second_exon_start, second_exon_end, long_exon_start, long_exon_end, short_es, short_ee")


def _twice(spark, sf):
    ev = fx.events(spark, sf)
    return ev.unionByName(ev.where("event_id % 3 = 0").withColumn("event_id", -F.col("event_id")))


_TWICE = ", twice AS (SELECT * FROM splice_events UNION ALL SELECT * REPLACE (-event_id AS event_id) FROM splice_events WHERE event_id % 3 = 0)\n"


@query("c7_identity_key_sql_nulls", _TWICE + "SELECT event_id FROM twice")
def c7(spark, sf):
    return dedup.drop_identity_conflicts(_twice(spark, sf)).select("event_id")


@query("c7_identity_key_null_safe", _TWICE + f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY {_IDENTITY} {_ORDER}) AS rn FROM twice) x WHERE rn = 1")
def c7_safe(spark, sf):
    return dedup.drop_identity_conflicts(_twice(spark, sf), null_safe=True).select("event_id")


COVERED = COVERAGE + ", covered AS (SELECT * FROM coverage WHERE c1 >= 10 AND c2 >= 10)\n"
COVERED_KEPT = (COVERED + _greedy("SE", SE_NEAR, "covered") + _greedy("RI", RI_NEAR, "covered")
                + _greedy("MXE", MXE_NEAR, "covered") + _alt("covered")
                + ", clean AS (SELECT event_id FROM se_kept UNION ALL SELECT event_id FROM ri_kept UNION ALL SELECT event_id FROM mxe_kept UNION ALL SELECT event_id FROM alt_kept)\n")


@query("c8_ingest_ledger", COVERED_KEPT + """SELECT (SELECT count(*) FROM coverage) AS n_parsed,
  (SELECT count(*) FROM coverage WHERE c1 IS NULL OR c2 IS NULL) AS n_missing_counts,
  (SELECT count(*) FROM coverage WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND (c1 < 10 OR c2 < 10)) AS n_low_coverage,
  (SELECT count(*) FROM covered) - (SELECT count(*) FROM clean) AS n_collapsed,
  (SELECT count(*) FROM clean) AS n_stored""")
def c8(spark, sf):
    parsed = fx.events(spark, sf)
    covered = coverage.filter_low_coverage(parsed)
    return ingest.ledger(parsed, covered, dedup.deduplicate(covered))


@query("flagship_top_clean_skipped_exons", COVERED + _greedy("SE", SE_NEAR, "covered")
       + f"""SELECT event_id, gene_symbol, chr, strand, exon_start, exon_end, fdr, inc_level_difference FROM splice_events JOIN se_kept USING (event_id)
  WHERE {SIG} ORDER BY fdr, abs(inc_level_difference) DESC, event_id LIMIT 20""")
def flagship(spark, sf):
    """Significant skipped exons of lowest FDR after cleaning."""
    clean = ingest.clean(fx.skipped(spark, sf))
    best = clean.where(fx.significant()).orderBy(
        "fdr", F.desc(F.abs("inc_level_difference")), "event_id").limit(20)
    return best.select("event_id", "gene_symbol", "chr", "strand", "exon_start", "exon_end",
                       "fdr", "inc_level_difference")

