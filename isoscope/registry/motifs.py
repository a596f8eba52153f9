"""Registered queries: motif enrichment and its views."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.functions.catalogue import MOTIFS, REGIONS, regulatory_effects
from isoscope.operators import motifs as mo
from isoscope.registry import fixtures as fx
from isoscope.registry.exons import HIT_SQL, SCAN_SQL
from isoscope.registry.tests import mwu_sql, normal_tail

R = fx.Registry()
query = R.query

# hit counts of every region of every skipped exon
_ALL = SCAN_SQL + HIT_SQL + """, dens AS MATERIALIZED (SELECT motif_name, protein, region, sig, hits AS hits, least(1.0, hits * width / cast(nt AS double)) AS v
  FROM hits JOIN se USING (event_id))
"""
_CELLS = "motif_name, protein, region"
_GRID = f""", grid AS (SELECT m.motif_name, m.protein, r.region FROM m CROSS JOIN (SELECT unnest({REGIONS!r}) AS region) r)
"""
_COMPARE = _ALL + _GRID + mwu_sql("dens", _CELLS) + f""", kk AS (SELECT {_CELLS}, cast(count(*) FILTER (WHERE sig AND hits > 0) AS double) AS k1, cast(count(*) FILTER (WHERE sig) AS double) AS n1,
    cast(count(*) FILTER (WHERE NOT sig AND hits > 0) AS double) AS k2, cast(count(*) FILTER (WHERE NOT sig) AS double) AS n2,
    avg(v) FILTER (WHERE sig) AS d1, avg(v) FILTER (WHERE NOT sig) AS d2 FROM dens GROUP BY {_CELLS}),
kz AS (SELECT {_CELLS}, (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM kk
  WHERE n1 >= 5 AND n2 >= 5 AND k1 + k2 > 0 AND k1 + k2 < n1 + n2),
kp AS ({normal_tail('kz', _CELLS)}),
r0 AS (SELECT grid.*, k1, kk.n1 AS n1, k2, kk.n2 AS n2, d1, d2, kp.z AS z, kp.p AS p, mwu_u.u AS u, mwu.p AS pu FROM grid LEFT JOIN kk USING ({_CELLS}) LEFT JOIN kp USING ({_CELLS}) LEFT JOIN mwu_u USING ({_CELLS}) LEFT JOIN mwu USING ({_CELLS})),
r1 AS (SELECT *, count(p) OVER () AS m1, row_number() OVER (ORDER BY p NULLS LAST, motif_name, region) AS i1, count(pu) OVER () AS m2, row_number() OVER (ORDER BY pu NULLS LAST, motif_name, region) AS i2 FROM r0),
r2 AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m1 / i1) OVER (ORDER BY i1 DESC)) END AS q, CASE WHEN pu IS NOT NULL THEN least(1.0, min(pu * m2 / i2) OVER (ORDER BY i2 DESC)) END AS qu FROM r1),
enriched AS (SELECT {_CELLS}, cast(k1 AS bigint) AS sig_hit_count, cast(n1 AS bigint) AS sig_total, cast(k2 AS bigint) AS bg_hit_count, cast(n2 AS bigint) AS bg_total,
  round(d1, 6) AS sig_density, round(d2, 6) AS bg_density, round(z, 4) AS z_stat, round(p, 6) AS p_value, round(q, 6) AS p_adjusted, coalesce(q < 0.05, false) AS significant,
  round(u, 4) AS density_u_stat, round(pu, 6) AS density_p_value, round(qu, 6) AS density_p_adjusted, coalesce(qu < 0.05, false) AS density_significant FROM r2)
"""


def _hits(spark, sf):
    return mo.tagged_hits(fx.events(spark, sf), fx.tags(spark, sf), fx.genome(spark, sf))


@query("f15_motif_scan", _ALL + f"SELECT {_CELLS}, sig AS in_a, count(*) FILTER (WHERE hits > 0) AS hit_count, count(*) AS total, round(avg(v), 9) AS mean_density FROM dens GROUP BY ALL")
def f15(spark, sf):
    return mo.scan_summary(mo.density_table(_hits(spark, sf))).withColumn(
        "mean_density", F.round("mean_density", 9))


@query("g6_motif_comparison", _COMPARE + "SELECT * FROM enriched")
def g6(spark, sf):
    return _enriched(spark, sf).drop("regulatory_effect")


def _enriched(spark, sf):
    return mo.motif_enrichment(fx.events(spark, sf), fx.tags(spark, sf), fx.genome(spark, sf))


_EFFECTS = ", ".join(f"('{p}', '{r}', '{e}')" for p, r, e in regulatory_effects() if e)


@query("g7_l7_motif_payload", _COMPARE + f", eff(protein, region, regulatory_effect) AS (VALUES {_EFFECTS}) SELECT enriched.*, regulatory_effect FROM enriched LEFT JOIN eff USING (protein, region)")
def g7(spark, sf):
    return _enriched(spark, sf)


@query("l7_group_sizes", "SELECT count(*) FILTER (WHERE sig) AS n_sig_events, count(*) FILTER (WHERE NOT sig) AS n_bg_events FROM se")
def l7(spark, sf):
    return mo.group_sizes(fx.events(spark, sf), fx.tags(spark, sf))


_QMIN = "least(p_adjusted, density_p_adjusted)"


@query("d15_group_lookup", _ALL + f"""SELECT a.motif_name, a.region, a.n AS n_sig, b.n AS n_bg FROM (SELECT motif_name, region, count(*) AS n FROM dens WHERE sig GROUP BY ALL) a
  JOIN (SELECT motif_name, region, count(*) AS n FROM dens WHERE NOT sig GROUP BY ALL) b USING (motif_name, region)""")
def d15(spark, sf):
    d = mo.scan_summary(mo.density_table(_hits(spark, sf)))
    side = lambda flag, name: d.where(F.col("in_a") == flag).select(
        "motif_name", "region", F.col("total").alias(name))
    return side(True, "n_sig").join(side(False, "n_bg"), ["motif_name", "region"])


@query("i10_least_significant_motifs", _COMPARE + f"SELECT motif_name, region, coalesce({_QMIN}, 1.0) AS min_q FROM enriched WHERE NOT (significant OR density_significant) ORDER BY min_q, region, motif_name LIMIT 30")
def i10(spark, sf):
    return mo.significant_rows(_enriched(spark, sf), either=False, top=30).select(
        "motif_name", "region", "min_q")


_ORDER = "CASE motif_name " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _, _) in enumerate(MOTIFS)) + " END"


@query("i11_best_motif_matrix", _COMPARE + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protein, region ORDER BY " + _QMIN + f", {_ORDER}) AS rn FROM enriched WHERE {_QMIN} IS NOT NULL) x WHERE rn = 1)\n"
       + "SELECT protein, " + ", ".join(f"max(motif_name) FILTER (WHERE region = '{r}') AS {r}" for r in REGIONS) + " FROM best GROUP BY protein")
def i11(spark, sf):
    return mo.best_motif_matrix(_enriched(spark, sf))


@query("i12_filtered_motifs", _COMPARE + f"SELECT motif_name, protein, region, {_QMIN} AS min_q FROM enriched WHERE region = 'skipped_exon'")
def i12(spark, sf):
    return mo.filtered_rows(_enriched(spark, sf), show_all=True, region="skipped_exon").select(
        "motif_name", "protein", "region", "min_q")
