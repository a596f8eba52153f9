"""Registered queries: permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.operators import permutation as pm
from isoscope.operators import ranking
from isoscope.registry import fixtures as fx

R = fx.Registry()


def _all_bins(counted: str) -> str:
    """Every one of the 40 bins, the empty ones too."""
    return f"SELECT cast(b.bin AS integer) AS bin, coalesce(x.n, 0) AS n FROM (SELECT unnest(range(40)) AS bin) b LEFT JOIN ({counted}) x ON b.bin = x.bin"


query = R.query

# every split of 5 or 6 slots as a bit mask; integers, so that equal splits tie
_NULLS = """, psi AS (SELECT event_id, gene_symbol, inc_level_difference,
    list_transform(list_filter(string_split(inc_level_1, ','), lambda t: TRY_CAST(t AS double) IS NOT NULL), lambda t: cast(round(cast(t AS double) * 1000) AS bigint)) AS a,
    list_transform(list_filter(string_split(inc_level_2, ','), lambda t: TRY_CAST(t AS double) IS NOT NULL), lambda t: cast(round(cast(t AS double) * 1000) AS bigint)) AS b FROM se),
pools AS (SELECT *, len(a) AS n1, len(b) AS n2, list_concat(a, b) AS pool, list_sum(a) AS s1, list_sum(list_concat(a, b)) AS total FROM psi),
masks AS (SELECT n, n1, mask FROM (SELECT unnest([5, 6]) AS n) x CROSS JOIN (SELECT unnest([2, 3]) AS n1) y CROSS JOIN (SELECT unnest(range(0, 64)) AS mask) z
  WHERE bit_count(cast(mask AS integer)) = n1 AND mask < (1 << n)),
nulls AS (SELECT p.event_id, p.n1, p.n2, n2 * s1 - p.n1 * (total - s1) AS obs,
    n2 * ps - p.n1 * (total - ps) AS d FROM (
      SELECT p.event_id, p.n1, p.n2, p.s1, p.total, m.mask,
        sum(CASE WHEN (m.mask >> i) & 1 = 1 THEN pool[i + 1] ELSE 0 END) AS ps
      FROM pools p JOIN masks m ON m.n = p.n1 + p.n2 AND m.n1 = p.n1 CROSS JOIN (SELECT unnest(range(0, 6)) AS i) g GROUP BY ALL) p),
perm AS (SELECT event_id, n1, n2, count(*) AS n_splits, count(*) FILTER (WHERE abs(d) >= abs(obs)) / cast(count(*) AS double) AS p, max(obs) / cast(max(n1 * n2 * 1000) AS double) AS tested FROM nulls GROUP BY event_id, n1, n2)
"""
# random splits by the generator's definition: wrap-around arithmetic in 128 bits
_WRAP = "18446744073709551616::UHUGEINT"
_STEP = 0x9E3779B97F4A7C15


def _random(iterations: int, seed: int = 42) -> str:
    times = lambda x, c: f"cast((cast({x} AS UHUGEINT) * {c}::UHUGEINT) % {_WRAP} AS UBIGINT)"
    return _NULLS + f""", draws AS (SELECT event_id, n1, n2, s1, total, pool, i, slot,
    cast((cast(xor(cast(cast('0x' || substr(md5(cast(event_id AS varchar)), 1, 15) AS BIGINT) AS UBIGINT), {seed * _STEP % 2 ** 64}::UBIGINT) AS UHUGEINT)
      + cast((i * (n1 + n2) + slot + 1) AS UHUGEINT) * {_STEP}::UHUGEINT) % {_WRAP} AS UBIGINT) AS z
  FROM pools CROSS JOIN (SELECT unnest(range(0, {iterations})) AS i) it CROSS JOIN (SELECT unnest(range(0, 6)) AS slot) sl WHERE slot < n1 + n2),
mixed AS (SELECT * EXCLUDE (z), {times('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z FROM draws),
again AS (SELECT * EXCLUDE (z), {times('xor(z, z >> 27)', 0x94D049BB133111EB)} AS z FROM mixed),
noise AS (SELECT * EXCLUDE (z), row_number() OVER (PARTITION BY event_id, i ORDER BY xor(z, z >> 31)) AS place FROM again),
splits AS (SELECT event_id, i, any_value(n1) AS n1, any_value(n2) AS n2, any_value(s1) AS s1, any_value(total) AS total,
    sum(CASE WHEN place <= n1 THEN pool[slot + 1] ELSE 0 END) AS ps FROM noise GROUP BY event_id, i),
random_p AS (SELECT event_id, round((count(*) FILTER (WHERE abs(n2 * ps - n1 * (total - ps)) >= abs(n2 * s1 - n1 * (total - s1))) + 1) / cast({iterations + 1} AS double), 4) AS p
  FROM splits GROUP BY event_id)
"""


_RAW = "coalesce(inc_level_difference, list_avg(a) / 1000.0 - list_avg(b) / 1000.0)"


def _results(spark, sf, iterations=500):
    return pm.event_permutations(fx.events(spark, sf), iterations)


@query("h1_exact_permutation", _NULLS + "SELECT event_id, cast(n_splits AS bigint) AS n_splits, round(p, 4) AS empirical_p_value FROM perm")
def h1(spark, sf):
    return _results(spark, sf).select("event_id", "n_splits", "empirical_p_value")


@query("h2_random_permutation", _random(100) + "SELECT event_id, p AS empirical_p_value, false AS exact FROM random_p")
def h2(spark, sf):
    """Every design forced onto the random path."""
    r = pm.event_permutations(fx.events(spark, sf), 100, max_splits=1)
    return r.select("event_id", "empirical_p_value", "exact")


@query("h3_event_results", _NULLS + f"""SELECT pools.event_id, gene_symbol, round({_RAW}, 4) AS observed_delta_psi, round(tested, 6) AS tested_delta_psi, round(p, 4) AS empirical_p_value, pools.n1, pools.n2, true AS exact,
  (SELECT string_agg(cast(c AS varchar), ',' ORDER BY bin) FROM (SELECT bin, count(*) FILTER (WHERE bin = least(19, greatest(0, (d + q.n1 * q.n2 * 1000) * 20 // (2 * q.n1 * q.n2 * 1000)))) AS c FROM nulls q CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) bb WHERE q.event_id = pools.event_id GROUP BY bin) h) AS event_hist
  FROM pools JOIN perm USING (event_id)""")
def h3(spark, sf):
    return _results(spark, sf).select(
        "event_id", "gene_symbol", "observed_delta_psi",
        F.round("tested_delta_psi", 6).alias("tested_delta_psi"), "empirical_p_value",
        "n1", "n2", "exact",
        F.array_join(F.transform("event_hist", lambda v: v.cast("string")), ",").alias("event_hist"))


@query("h4_null_histogram", _NULLS + _all_bins("SELECT cast(least(39, greatest(0, (d + n1 * n2 * 1000) * 40 // (2 * n1 * n2 * 1000))) AS integer) AS bin, count(*) AS n FROM nulls GROUP BY 1"))
def h4(spark, sf):
    return pm.null_histogram(_results(spark, sf)).select("bin", "n")


@query("h4_observed_histogram", _NULLS + _all_bins(f"SELECT cast(least(greatest(floor(({_RAW} + 1.0) / 0.05), 0), 39) AS integer) AS bin, count(*) AS n FROM pools GROUP BY 1"))
def h4_observed(spark, sf):
    return pm.observed_histogram(_results(spark, sf)).select("bin", "n")


_SUMMARY = """count(*) AS n_events_tested, round(count(*) FILTER (WHERE round(p, 4) < 0.05) * 100.0 / count(*), 1) AS pct_p05,
  round(count(*) FILTER (WHERE round(p, 4) < 0.01) * 100.0 / count(*), 1) AS pct_p01, cast(1.0 AS double) AS exact_fraction"""


@query("h5_shares", _NULLS + f"SELECT {_SUMMARY} FROM perm")
def h5(spark, sf):
    return pm.shares(_results(spark, sf))


@query("h6_modal_design", _NULLS + "SELECT n1 AS n_replicates_g1, n2 AS n_replicates_g2, round(1.0 / any_value(n_splits), 9) AS min_p_attainable FROM perm GROUP BY n1, n2 ORDER BY count(*) DESC, n1, n2 LIMIT 1")
def h6(spark, sf):
    return pm.modal_design(_results(spark, sf)).withColumn(
        "min_p_attainable", F.round("min_p_attainable", 9))


@query("f22_permutation_summary", _NULLS + f"SELECT {_SUMMARY}, cast(3 AS integer) AS n_replicates_g1, cast(3 AS integer) AS n_replicates_g2, round(1.0 / 20, 9) AS min_p_attainable FROM perm")
def f22(spark, sf):
    return pm.permutation_summary(_results(spark, sf)).withColumn(
        "min_p_attainable", F.round("min_p_attainable", 9))


def _metrics(spark, sf):
    # the sign split needs the effect only, not the permutation itself
    signed = pm.event_inputs(fx.events(spark, sf)).select("event_id", F.col("delta").alias("observed_raw"))
    return pm.metric_distribution(pm.metric_values(signed, fx.features(spark, sf)))


@query("h7_metric_permutation")
def h7(spark, sf):
    return pm.metric_permutations(_metrics(spark, sf), 200)[0]


@query("h7_metric_histograms")
def h7_hist(spark, sf):
    return pm.metric_histograms(pm.metric_permutations(_metrics(spark, sf), 200)[1])


_SIGNED = f", signed AS (SELECT event_id, {_RAW} AS raw FROM pools), mf AS (SELECT f.*, raw > 0 AS first_ FROM features f JOIN signed USING (event_id) WHERE raw <> 0)\n"


@query("h8_metric_values", _NULLS + _SIGNED + """, lim AS (SELECT min(exon_size) AS lo, max(exon_size) AS hi FROM mf), mv AS (
  SELECT 'ppt_score' AS metric, first_, ppt_score AS v FROM mf UNION ALL SELECT 'exon_size', first_, (exon_size - lo) / cast(greatest(hi - lo, 1) AS double) FROM mf CROSS JOIN lim
  UNION ALL SELECT 'frame_in_frame', first_, CASE WHEN frame_class <> 'unknown' THEN cast(frame_class = 'in_frame' AS integer) END FROM mf
  UNION ALL SELECT 'canonical_sites', first_, list_avg(list_filter([cast(donor_is_gt AS integer), cast(acceptor_is_ag AS integer)], lambda x: x IS NOT NULL)) FROM mf)
SELECT metric, count(*) FILTER (WHERE first_) AS n_g2, count(*) FILTER (WHERE NOT first_) AS n_g1, round(avg(v) FILTER (WHERE first_) - avg(v) FILTER (WHERE NOT first_), 4) AS observed_stat FROM mv WHERE v IS NOT NULL GROUP BY metric""")
def h8(spark, sf):
    return pm.metric_permutations(_metrics(spark, sf), 10)[0].select(
        "metric", "n_g2", "n_g1", "observed_stat")


@query("h9_significant_view", _NULLS + f"SELECT {_SUMMARY} FROM perm JOIN se USING (event_id) WHERE sig")
def h9(spark, sf):
    ev = fx.events(spark, sf)
    return pm.shares(pm.significant_view(_results(spark, sf), ev, fx.significant()))


@query("h9_significant_histogram", _NULLS + _all_bins(f"SELECT cast(least(greatest(floor((round({_RAW}, 4) + 1.0) / 0.05), 0), 39) AS integer) AS bin, count(*) AS n FROM pools JOIN se USING (event_id) WHERE sig GROUP BY 1".replace("coalesce(inc_level_difference,", "coalesce(pools.inc_level_difference,")))
def h9_hist(spark, sf):
    ev = fx.events(spark, sf)
    kept = pm.significant_view(_results(spark, sf), ev, fx.significant())
    return pm.observed_histogram(kept, "observed_delta_psi").select("bin", "n")


@query("h10_convergence_table", _NULLS + f"SELECT cast(500 AS integer) AS iterations, 'exact enumeration (all label permutations)' AS label, {_SUMMARY}, cast(3 AS integer) AS n_replicates_g1, cast(3 AS integer) AS n_replicates_g2, round(1.0 / 20, 9) AS min_p_attainable FROM perm JOIN se USING (event_id) WHERE sig")
def h10(spark, sf):
    return pm.convergence_table(fx.events(spark, sf).where(fx.significant())).withColumn(
        "min_p_attainable", F.round("min_p_attainable", 9))


@query("h11_clamped_iterations", _random(10) + "SELECT false AS exact, min(p) AS smallest_p, count(*) AS n FROM random_p")
def h11(spark, sf):
    """Asked for 3 iterations: the lower limit of 10 applies, so p >= 1/11."""
    r = pm.event_permutations(fx.events(spark, sf), 3, max_splits=1)
    return r.groupBy("exact").agg(F.min("empirical_p_value").alias("smallest_p"),
                                  F.count(F.lit(1)).alias("n"))


@query("i9_top_permutation", _NULLS + "SELECT event_id, round(p, 4) AS empirical_p_value FROM perm ORDER BY round(p, 4), event_id LIMIT 15")
def i9(spark, sf):
    return ranking.top_permutation(_results(spark, sf)).select("event_id", "empirical_p_value")
