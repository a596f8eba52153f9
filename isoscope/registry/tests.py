"""Registered queries: hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.operators import hypothesis as hy
from isoscope.registry import fixtures as fx

R = fx.Registry()
query = R.query

STEPS = 2000
_WEIGHT = f"CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def normal_tail(source: str, keys: str, z: str = "z", out: str = "p") -> str:
    """Two-sided normal p by a Simpson sum over each row's own |z|."""
    return f"""SELECT {keys}, {z}, abs(1 - 2 * sum({_WEIGHT} * exp(-({z} * i / {STEPS}) * ({z} * i / {STEPS}) / 2)) * abs({z}) / {STEPS} / 3 / sqrt(2 * pi())) AS {out}
  FROM (SELECT *, unnest(range(0, {STEPS} + 1)) AS i FROM {source}) g GROUP BY {keys}, {z}"""


def t_tail(source: str, keys: str) -> str:
    return f"""SELECT {keys}, t, df, abs(1 - 2 * sum({_WEIGHT} * pow(1 + (t * i / {STEPS}) * (t * i / {STEPS}) / df, -(df + 1) / 2)) * abs(t) / {STEPS} / 3
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())) AS p FROM (SELECT *, unnest(range(0, {STEPS} + 1)) AS i FROM {source}) g GROUP BY {keys}, t, df"""


_FRACTION = "length(regexp_replace(ppt_seq, '[^{0}]', '', 'g')) / cast(length(ppt_seq) AS double)"
_VALUES = {
    "mean_delta_psi": "inc_level_difference", "exon_size": "exon_size",
    "ppt_score": "CASE WHEN donor_seq IS NOT NULL THEN ppt_score END",
    "ppt_t_content": _FRACTION.format("T"), "ppt_c_content": _FRACTION.format("C"),
    "upstream_intron_size": "upstream_intron_size", "downstream_intron_size": "downstream_intron_size",
    "canonical_gt": "cast(donor_is_gt AS integer)", "canonical_ag": "cast(acceptor_is_ag AS integer)",
    "in_frame_pct": "CASE WHEN frame_class <> 'unknown' THEN cast(frame_class = 'in_frame' AS integer) END",
    "bp_found": "CASE WHEN ppt_seq IS NOT NULL THEN cast(bp_motif_found AS integer) END",
    "upstream_canonical_gt": "cast(upstream_donor_is_gt AS integer)",
    "downstream_canonical_ag": "cast(downstream_acceptor_is_ag AS integer)",
}
# the feature table is written out once for the oracle
VALUE_SQL = ", rows_ AS MATERIALIZED (SELECT * FROM joined), vals AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS feature, sig, cast({v} AS double) AS v FROM rows_" for k, v in _VALUES.items()
) + ")\n"
_NUM = "(" + ", ".join(f"'{c}'" for c in hy.CONTINUOUS) + ")"
_PROP = "(" + ", ".join(f"'{c}'" for c in hy.PROPORTIONS) + ")"


def mwu_sql(source: str, keys: str, name: str = "mwu") -> str:
    """U by average ranks of every single value (not by counts of distinct ones)."""
    return f""", {name}_ranked AS (SELECT {keys}, sig, v, rank() OVER (PARTITION BY {keys} ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY {keys}, v) AS tied FROM {source} WHERE v IS NOT NULL),
{name}_s AS (SELECT {keys}, cast(count(*) FILTER (WHERE sig) AS double) AS n1, cast(count(*) FILTER (WHERE NOT sig) AS double) AS n2,
    sum(CASE WHEN sig THEN cast(r AS double) ELSE 0 END) AS r1, sum(cast(tied AS double) * tied - 1) AS ties FROM {name}_ranked GROUP BY {keys}),
{name}_u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS s2 FROM {name}_s WHERE n1 >= 5 AND n2 >= 5),
{name}_z AS (SELECT *, CASE WHEN s2 > 0 THEN (u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / sqrt(s2) END AS z FROM {name}_u),
{name} AS ({normal_tail(f"(SELECT {keys}, u, coalesce(z, 0) AS z FROM {name}_z WHERE z IS NOT NULL)", keys + ", u")})
"""


WELCH_SQL = f""", m AS (SELECT feature, avg(v) FILTER (WHERE sig) AS m1, avg(v) FILTER (WHERE NOT sig) AS m2, var_samp(v) FILTER (WHERE sig) / count(v) FILTER (WHERE sig) AS a,
    var_samp(v) FILTER (WHERE NOT sig) / count(v) FILTER (WHERE NOT sig) AS b, count(v) FILTER (WHERE sig) AS n1, count(v) FILTER (WHERE NOT sig) AS n2 FROM vals WHERE feature IN {_NUM} GROUP BY feature),
w AS (SELECT feature, (m1 - m2) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM m),
welch AS ({t_tail('w', 'feature')})
"""
PROP_SQL = f""", k AS (SELECT feature, cast(sum(v) FILTER (WHERE sig) AS double) AS k1, cast(count(v) FILTER (WHERE sig) AS double) AS n1, cast(sum(v) FILTER (WHERE NOT sig) AS double) AS k2,
    cast(count(v) FILTER (WHERE NOT sig) AS double) AS n2 FROM vals WHERE feature IN {_PROP} GROUP BY feature),
pz AS (SELECT feature, (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM k),
prop AS ({normal_tail('pz', 'feature')})
"""
NUMERIC_SQL = f", numeric_vals AS (SELECT * FROM vals WHERE feature IN {_NUM})\n"


def _compressed(spark, sf, names):
    values = hy.panel_values(fx.joined(spark, sf)).where(F.col("feature").isin(*names))
    return hy.compress(values, ["feature"])


@query("g1_proportion_test", VALUE_SQL + PROP_SQL + "SELECT feature, round(z, 6) AS z, round(p, 6) AS p FROM prop")
def g1(spark, sf):
    c = _compressed(spark, sf, hy.PROPORTIONS)
    hit = F.col("value") == 1
    counts = c.groupBy("feature").agg(
        F.sum(F.when(hit, F.col("n_a")).otherwise(0)).alias("k1"), F.sum("n_a").alias("n1"),
        F.sum(F.when(hit, F.col("n_b")).otherwise(0)).alias("k2"), F.sum("n_b").alias("n2"))
    return hy.with_proportion_test(counts).select(
        "feature", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("g2_mann_whitney", VALUE_SQL + NUMERIC_SQL + mwu_sql("numeric_vals", "feature") + "SELECT feature, round(u, 1) AS u, round(p, 6) AS p FROM mwu")
def g2(spark, sf):
    c = _compressed(spark, sf, hy.CONTINUOUS)
    return hy.mann_whitney(c, ["feature"]).select(
        "feature", F.round("u", 1).alias("u"), F.round("p", 6).alias("p"))


@query("g3_welch", VALUE_SQL + WELCH_SQL + "SELECT feature, round(t, 6) AS t, round(df, 3) AS df, round(p, 6) AS p FROM welch")
def g3(spark, sf):
    c = _compressed(spark, sf, hy.CONTINUOUS)
    return hy.welch(c, ["feature"]).select(
        "feature", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("p", 6).alias("p"))


@query("g4_benjamini_hochberg", """, best AS (SELECT gene_id, min(p_value) AS p, min(event_id) AS id FROM splice_events GROUP BY gene_id),
fam AS (SELECT gene_id, id % 3 AS family, CASE WHEN id % 7 <> 0 THEN p END AS p FROM best),
ranked AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, gene_id) AS i FROM fam)
SELECT gene_id, family, p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(CASE WHEN p IS NOT NULL THEN p * m / i END) OVER (PARTITION BY family ORDER BY i DESC)) END, 9) AS q FROM ranked""")
def g4(spark, sf):
    best = fx.events(spark, sf).groupBy("gene_id").agg(
        F.min("p_value").alias("p"), F.min("event_id").alias("id"))
    fam = best.select("gene_id", (F.col("id") % 3).alias("family"),
                      F.when(F.col("id") % 7 != 0, F.col("p")).alias("p"))
    return hy.benjamini_hochberg(fam, ["family"], "p", "q", ["gene_id"]).withColumn(
        "q", F.round("q", 9))


@query("g5_test_panel", VALUE_SQL + NUMERIC_SQL + mwu_sql("numeric_vals", "feature") + WELCH_SQL + PROP_SQL + """, tests AS (
  SELECT feature, 'Welch''s t-test' AS test_name, t AS statistic, p FROM welch UNION ALL SELECT feature || '_mwu', 'mann_whitney_u', u, p FROM mwu UNION ALL SELECT feature, 'Proportion z-test', z, p FROM prop),
ranked AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS i FROM tests),
adjusted AS (SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC)) AS q FROM ranked)
SELECT feature, test_name, round(statistic, 4) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant, round(q, 6) AS q_value, q < 0.05 AS significant_fdr FROM adjusted""")
def g5(spark, sf):
    return hy.test_panel(fx.joined(spark, sf)).withColumns(
        {"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 6)})
