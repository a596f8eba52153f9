"""Two-group tests on value distributions, and false-discovery control.

All tests of a job share one compressed table (keys, value, n_a, n_b): one row per
distinct value.  It is aggregated map-side, so its size follows the number of
distinct values and not the number of events; rank sums then come from running
totals over it instead of per-row ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.functions.catalogue import MIN_GROUP_N
from isoscope.functions.numeric import normal_two_sided, student_t_two_sided
from isoscope.functions.sequence import base_fraction
from isoscope.plans.lineage import materialize
from isoscope.plans.prefix import running_totals


def compress(values: DataFrame, keys: list[str], in_a: str = "in_a") -> DataFrame:
    """(keys, value, boolean group) rows -> counts per distinct value."""
    return values.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(
        F.count_if(F.col(in_a)).alias("n_a"), F.count_if(~F.col(in_a)).alias("n_b")
    )


# -- single tests -----------------------------------------------------------------
def proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; null for small groups or a pooled share of 0 or 1."""
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    usable = (n1 >= MIN_GROUP_N) & (n2 >= MIN_GROUP_N) & (pooled > 0) & (pooled < 1)
    return F.when(usable, F.try_divide(k1 / n1 - k2 / n2, se))


def with_proportion_test(df: DataFrame) -> DataFrame:
    """Adds z and p to rows (k1, n1, k2, n2)."""
    z = proportion_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return df.withColumn("z", z).withColumn("p", normal_two_sided("z"))


def mann_whitney(compressed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n1, n2, u, p): two-sided, tie-corrected, 0.5 continuity correction.

    U of group A counts, for each distinct value, the B rows below plus half of the
    B rows tied with it.  Null below the group minimum; p null when all tie.
    """
    below = running_totals(compressed, keys, ["value"], {"b_below": "n_b"})
    t = (F.col("n_a") + F.col("n_b")).cast("double")
    sums = below.groupBy(*keys).agg(
        F.sum("n_a").alias("n1"), F.sum("n_b").alias("n2"),
        F.sum(F.col("n_a") * (F.col("b_below") + F.col("n_b") / 2)).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    diff = F.col("u") - n1 * n2 / 2
    z = F.when(variance > 0, (diff - F.signum(diff) * 0.5) / F.sqrt(variance))
    usable = (F.col("n1") >= MIN_GROUP_N) & (F.col("n2") >= MIN_GROUP_N)
    out = sums.withColumn("z", F.when(usable, z)).withColumn("u", F.when(usable, F.col("u")))
    return out.select(*keys, "n1", "n2", "u", normal_two_sided("z").alias("p"))


def welch(compressed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, df, p) of Welch's test, from weighted central moments."""
    v, na, nb = F.col("value"), F.col("n_a"), F.col("n_b")
    means = compressed.groupBy(*keys).agg(
        F.sum("n_a").alias("n1"), F.sum("n_b").alias("n2"),
        F.try_divide(F.sum(v * na), F.sum(na)).alias("m1"),
        F.try_divide(F.sum(v * nb), F.sum(nb)).alias("m2"),
    )
    centred = compressed.join(means.select(*keys, "m1", "m2"), keys)
    squares = centred.groupBy(*keys).agg(
        F.sum(na * (v - F.col("m1")) * (v - F.col("m1"))).alias("ss1"),
        F.sum(nb * (v - F.col("m2")) * (v - F.col("m2"))).alias("ss2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    a = F.try_divide(F.try_divide(F.col("ss1"), n1 - 1), n1)
    b = F.try_divide(F.try_divide(F.col("ss2"), n2 - 1), n2)
    usable = (n1 >= 2) & (n2 >= 2) & (a + b > 0)
    df = F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))
    return (
        means.join(squares, keys)
        .withColumns({
            "t": F.when(usable, (F.col("m1") - F.col("m2")) / F.sqrt(a + b)),
            "df": F.when(usable, df),
        })
        .select(*keys, "t", "df", student_t_two_sided("t", "df").alias("p"))
    )


def benjamini_hochberg(
    tests: DataFrame, family: list[str], p: str, q: str, tie: list[str]
) -> DataFrame:
    """Adds q-values inside each family; missing p-values do not count and stay
    missing.  A family is one report's tests (tens to thousands of rows)."""
    present = F.col(p).isNotNull()
    every = Window.partitionBy(*family)
    up = every.orderBy(F.col(p).asc_nulls_last(), *tie)
    ranked = tests.withColumns(
        {"_m": F.count(p).over(every), "_i": F.row_number().over(up)}
    )
    larger = Window.partitionBy(*family).orderBy(F.desc("_i")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    scaled = F.when(present, F.col(p) * F.col("_m") / F.col("_i"))
    return ranked.withColumn(
        q, F.when(present, F.least(F.lit(1.0), F.min(scaled).over(larger)))
    ).drop("_m", "_i")


# -- the feature panel ---------------------------------------------------------------
CONTINUOUS = [
    "mean_delta_psi", "exon_size", "ppt_score", "ppt_t_content", "ppt_c_content",
    "upstream_intron_size", "downstream_intron_size",
]
PROPORTIONS = [
    "canonical_gt", "canonical_ag", "in_frame_pct", "bp_found",
    "upstream_canonical_gt", "downstream_canonical_ag",
]


def panel_values(joined: DataFrame, group: str = "is_significant") -> DataFrame:
    """Long (feature, value, in_a) of the 13 panel features with their own filters."""
    ppt = F.length("ppt_seq") > 0
    frame = F.col("frame_class")
    as_number = lambda flag: flag.cast("double")
    values = {
        "mean_delta_psi": F.col("inc_level_difference"),
        "exon_size": F.col("exon_size").cast("double"),
        "ppt_score": F.when(F.length("donor_seq") > 0, F.col("ppt_score")),
        "ppt_t_content": F.when(ppt, base_fraction(F.col("ppt_seq"), "T")),
        "ppt_c_content": F.when(ppt, base_fraction(F.col("ppt_seq"), "C")),
        "upstream_intron_size": F.col("upstream_intron_size").cast("double"),
        "downstream_intron_size": F.col("downstream_intron_size").cast("double"),
        "canonical_gt": as_number(F.col("donor_is_gt").cast("int")),
        "canonical_ag": as_number(F.col("acceptor_is_ag").cast("int")),
        "in_frame_pct": F.when(
            frame.isNotNull() & (frame != "") & (frame != "unknown"),
            (frame == "in_frame").cast("int").cast("double")),
        "bp_found": F.when(
            ppt, F.coalesce(F.col("bp_motif_found"), F.lit(False)).cast("int").cast("double")),
        "upstream_canonical_gt": as_number(F.col("upstream_donor_is_gt").cast("int")),
        "downstream_canonical_ag": as_number(F.col("downstream_acceptor_is_ag").cast("int")),
    }
    rows = F.array(*[
        F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()
    ])
    return joined.select(F.col(group).alias("in_a"), F.inline(rows))


def test_panel(joined: DataFrame, group: str = "is_significant") -> DataFrame:
    """20 tests of group A (significant) against the rest, adjusted as one family."""
    small = materialize(compress(panel_values(joined, group), ["feature"]), "panel")
    numeric = small.where(F.col("feature").isin(*CONTINUOUS))
    flags = small.where(F.col("feature").isin(*PROPORTIONS))
    t = welch(numeric, ["feature"]).select(
        "feature", F.lit("Welch's t-test").alias("test_name"), F.col("t").alias("statistic"),
        F.col("p").alias("p_value"))
    u = mann_whitney(numeric, ["feature"]).select(
        F.concat("feature", F.lit("_mwu")).alias("feature"),
        F.lit("mann_whitney_u").alias("test_name"),
        F.col("u").alias("statistic"), F.col("p").alias("p_value"))
    hit = F.col("value") == 1
    counts = flags.groupBy("feature").agg(
        F.sum(F.when(hit, F.col("n_a")).otherwise(0)).alias("k1"), F.sum("n_a").alias("n1"),
        F.sum(F.when(hit, F.col("n_b")).otherwise(0)).alias("k2"), F.sum("n_b").alias("n2"),
    )
    z = with_proportion_test(counts).select(
        "feature", F.lit("Proportion z-test").alias("test_name"), F.col("z").alias("statistic"),
        F.col("p").alias("p_value"))
    # a test without any value still has its row
    named = [(f, "Welch's t-test") for f in CONTINUOUS]
    named += [(f"{f}_mwu", "mann_whitney_u") for f in CONTINUOUS]
    named += [(f, "Proportion z-test") for f in PROPORTIONS]
    frame = joined.sparkSession.createDataFrame(named, "feature string, test_name string")
    done = frame.join(t.unionByName(u).unionByName(z), ["feature", "test_name"], "left")
    adjusted = benjamini_hochberg(
        done.withColumn("_family", F.lit(1)), ["_family"], "p_value", "q_raw", ["feature"])
    return adjusted.select(
        "feature", "test_name", "statistic", "p_value",
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
        F.round("q_raw", 6).alias("q_value"),
        F.coalesce(F.col("q_raw") < 0.05, F.lit(False)).alias("significant_fdr"),
    )
