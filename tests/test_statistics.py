"""Golden vectors and brute-force checks of the numeric operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from isoscope.functions import numeric
from isoscope.operators import hypothesis as hy
from isoscope.operators import permutation as pm
from isoscope.plans import prefix


def compressed(spark, a, b):
    rows = [("t", float(v), True) for v in a] + [("t", float(v), False) for v in b]
    return hy.compress(spark.createDataFrame(rows, "k string, value double, in_a boolean"), ["k"])


def test_welch_golden(spark):
    r = hy.welch(compressed(spark, [1, 2, 3, 4, 5], [2, 3, 4, 5, 6]), ["k"]).first()
    assert r["t"] == pytest.approx(-1.0) and r["p"] == pytest.approx(0.3466, abs=1e-4)


def test_welch_guards(spark):
    assert hy.welch(compressed(spark, [1], [2, 3]), ["k"]).first()["t"] is None
    assert hy.welch(compressed(spark, [2, 2], [2, 2]), ["k"]).first()["p"] is None


@pytest.mark.parametrize("a, b, u, p", [
    ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10], 0, 0.01218),
    ([1, 2, 3], [4, 5, 6], None, None),
    ([1] * 6, [1] * 7, 21, None),
])
def test_mann_whitney_golden(spark, a, b, u, p):
    r = hy.mann_whitney(compressed(spark, a, b), ["k"]).first()
    assert r["u"] == u
    assert r["p"] == (None if p is None else pytest.approx(p, abs=1e-5))


def test_mann_whitney_equals_pair_counting(spark):
    rng = random.Random(3)
    a = [rng.randrange(12) for _ in range(40)]
    b = [rng.randrange(3, 14) for _ in range(55)]
    want = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert hy.mann_whitney(compressed(spark, a, b), ["k"]).first()["u"] == want


def test_proportion_golden(spark):
    df = spark.createDataFrame([(50, 100, 30, 100), (1, 4, 2, 50), (9, 9, 9, 9)], "k1 long, n1 long, k2 long, n2 long")
    rows = hy.with_proportion_test(df).collect()
    assert rows[0]["z"] == pytest.approx(2.887, abs=1e-3) and rows[0]["p"] == pytest.approx(0.0039, abs=1e-4)
    assert rows[1]["z"] is None and rows[2]["p"] is None


def test_benjamini_hochberg_golden(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005), (4, None)], "i int, p double")
    got = hy.benjamini_hochberg(df.withColumn("f", F.lit(1)), ["f"], "p", "q", ["i"]).orderBy("i").collect()
    assert [r["q"] for r in got][:4] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[4]["q"] is None


@pytest.mark.parametrize("t, df, p", [(2.0, 1.0, 0.295167), (0.0, 7.0, 1.0), (2.228139, 10.0, 0.05), (1.959964, 1e7, 0.05)])
def test_t_tail(t, df, p):
    assert numeric.t_two_sided_value(t, df) == pytest.approx(p, abs=2e-6)


def test_hypergeometric_tail(spark):
    df = spark.createDataFrame([(20, 7, 5, 2), (10, 3, 3, 0)], "n long, m long, d long, k long")
    got = [r[0] for r in df.select(numeric.hypergeometric_tail("n", "m", "d", "k")).collect()]
    want = sum(math.comb(7, i) * math.comb(13, 5 - i) for i in range(2, 6)) / math.comb(20, 5)
    assert got == pytest.approx([want, 1.0])


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [("ab"[i % 2], i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, n long").repartition(7)
    got = {(r["g"], r["o"]): r["before"] for r in prefix.running_totals(df, ["g"], ["o"], {"before": "n"}).collect()}
    for g, o, _ in rows:
        assert got[g, o] == sum(n for h, p, n in rows if h == g and p < o)


def test_row_numbers(spark):
    df = spark.range(1000).withColumn("x", F.hash("id"))
    got = prefix.row_numbers(df, [F.col("x"), F.col("id")], "rn").orderBy("x", "id").collect()
    assert [r["rn"] for r in got] == list(range(1, 1001))


# -- permutations --------------------------------------------------------------------
def events(spark, rows):
    return spark.createDataFrame(
        [(i, "SE", f"G{i}", a, b, d) for i, (a, b, d) in enumerate(rows)],
        "event_id long, event_type string, gene_symbol string, inc_level_1 string, inc_level_2 string, inc_level_difference double")


def test_two_against_two(spark):
    r = pm.event_permutations(events(spark, [("0.9,0.8", "0.1,0.2", None)])).first()
    assert r["empirical_p_value"] == pytest.approx(2 / 6, abs=1e-4)
    assert (r["n_splits"], r["exact"], r["observed_delta_psi"]) == (6, True, 0.7)
    assert sum(r["null_hist"]) == 6 and sum(r["event_hist"]) == 6


def test_exact_equals_enumeration(spark):
    rng = random.Random(5)
    a, b = [[round(rng.random(), 3) for _ in range(3)] for _ in range(2)]
    r = pm.event_permutations(events(spark, [(",".join(map(str, a)), ",".join(map(str, b)), 0.5)])).first()
    pool, seen = a + b, abs(sum(a) - sum(b))
    hits = sum(abs(2 * sum(c) - sum(pool)) >= seen - 1e-9 for c in itertools.combinations(pool, 3))
    assert r["empirical_p_value"] == pytest.approx(hits / 20)


def test_events_without_values_are_skipped(spark):
    rows = [("NA,2.0", "0.1", 0.1), ("0.5", None, 0.1), ("0.5,nan", "0.25", None)]
    assert [r["event_id"] for r in pm.event_permutations(events(spark, rows)).collect()] == [2]


def test_random_path_is_reproducible_and_never_zero(spark):
    ev = events(spark, [("0.9,0.8,0.95", "0.1,0.2,0.15", 0.7)] * 30)
    one = pm.event_permutations(ev, 200, max_splits=1).orderBy("event_id").collect()
    two = pm.event_permutations(ev.repartition(5), 200, max_splits=1).orderBy("event_id").collect()
    assert [r["empirical_p_value"] for r in one] == [r["empirical_p_value"] for r in two]
    assert min(r["empirical_p_value"] for r in one) >= round(1 / 201, 4)
    assert sum(r["empirical_p_value"] for r in one) / 30 == pytest.approx(0.1, abs=0.03)


def test_metric_draws_match_the_exact_distribution(spark):
    rows = [("m", v, v < 6) for v in map(float, range(12))]
    values = spark.createDataFrame(rows, "metric string, value double, first boolean").withColumn("metric", F.lit("ppt_score"))
    dist = pm.metric_distribution(values)
    exact = pm.metric_permutations(dist, 2000)[0].where("metric = 'ppt_score'").first()
    drawn = pm.metric_permutations(dist, 2000, max_splits=1)[0].where("metric = 'ppt_score'").first()
    assert exact["exact"] and exact["n_splits"] == 924 and not drawn["exact"]
    assert exact["empirical_p_value"] == pytest.approx(2 / 924, abs=1e-4)
    assert drawn["empirical_p_value"] < 0.01
    spread = [pm.metric_permutations(dist, 2000, max_splits=m)[1].agg(F.stddev_pop("null")).first()[0] for m in (5000, 1)]
    assert spread[0] == pytest.approx(spread[1], rel=0.06)
