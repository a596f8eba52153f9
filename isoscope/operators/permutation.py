"""Label-permutation tests per event and per metric."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoscope.functions.catalogue import EXACT_MAX_SPLITS
from isoscope.functions.cells import mean, psi_list
from isoscope.functions.numeric import binomial, histogram_bin, histogram_edge
from isoscope.plans.lineage import materialize

# PSI values are compared as integers, so that equal splits tie exactly whatever the order of
# summation.  Twelve decimals are exact (a double holds them); more are rounded.  All sums
# fit 64 bits for up to 300 replicates in each group.
PSI_SCALE = 10 ** 12
NULL_BINS = 40
EVENT_BINS = 20
METRIC_BINS = 30
ITERATION_RANGE = (10, 2000)
CONVERGENCE = (50, 100, 250, 500)


def clamped_iterations(n: int) -> int:
    lo, hi = ITERATION_RANGE
    return max(lo, min(n, hi))


def _splits(n: int, n1: int) -> np.ndarray:
    """0/1 matrix of every way to pick n1 of n; the first row is the observed one."""
    picks = np.array(list(combinations(range(n), n1)))
    matrix = np.zeros((len(picks), n), dtype=np.int64)
    np.put_along_axis(matrix, picks, 1, axis=1)
    return matrix


def _noise(seed: int, keys: np.ndarray, iterations: int, n: int) -> np.ndarray:
    """Uniform 64-bit noise (row, iteration, slot) from a counter-based mixer: it
    depends on seed, event and position only, so partitioning cannot change it, and any
    engine with 64-bit wrap-around can state it."""
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        counter = np.arange(iterations * n, dtype=np.uint64).reshape(iterations, n)
        z = keys[:, None, None] ^ (np.uint64(seed) * step)
        z = z + (counter[None] + np.uint64(1)) * step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _batch_nulls(pool: np.ndarray, n1: int, keys: np.ndarray, iterations: int, seed: int,
                 max_splits: int, known: dict) -> tuple[np.ndarray, np.ndarray, bool]:
    """(null, observed, exact) as integers n1*n2*scale times the mean difference."""
    n = pool.shape[1]
    n2 = n - n1
    total = pool.sum(axis=1)
    diff = lambda s1: n2 * s1 - n1 * (total[:, None] - s1)
    observed = diff(pool[:, :n1].sum(axis=1)[:, None])[:, 0]
    if math.comb(n, n1) <= max_splits:
        if (n, n1) not in known:
            known[n, n1] = _splits(n, n1).T
        return diff(pool @ known[n, n1]), observed, True
    order = np.argsort(_noise(seed, keys, iterations, n), axis=2)[:, :, :n1]
    first = np.take_along_axis(pool[:, None, :], order, axis=2).sum(axis=2)
    return diff(first), observed, False


def _histograms(null: np.ndarray, unit: int, bins: int) -> np.ndarray:
    """Row-wise bin counts on [-1, 1] in exact integer arithmetic."""
    index = np.clip((null + unit) * bins // (2 * unit), 0, bins - 1)
    flat = index + np.arange(len(null))[:, None] * bins
    return np.bincount(flat.ravel(), minlength=len(null) * bins).reshape(len(null), bins)


# event columns that travel through the test, so that no join has to bring them back
CARRIED = ["event_id", "gene_symbol", "delta", "n1", "n2"]


def _event_tests(iterations: int, seed: int, max_splits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}  # split matrices by design
        for batch in batches:
            for (n1, n2), rows in batch.groupby(["n1", "n2"], sort=False):
                n1, n2 = int(n1), int(n2)
                # bound the working set: rows x splits x slots
                splits = min(math.comb(n1 + n2, n1), max(max_splits, iterations))
                if math.comb(n1 + n2, n1) > max_splits:
                    splits = iterations * (n1 + n2)
                block = max(1, 4_000_000 // splits)
                for at in range(0, len(rows), block):
                    part = rows.iloc[at:at + block]
                    pool = np.array(part["pool"].tolist(), dtype=np.int64)
                    null, seen, exact = _batch_nulls(
                        pool, n1, part["key"].to_numpy().astype(np.uint64), iterations, seed,
                        max_splits, known)
                    hits = (np.abs(null) >= np.abs(seen)[:, None]).sum(axis=1)
                    p = hits / null.shape[1] if exact else (hits + 1) / (null.shape[1] + 1)
                    hist = _histograms(null, n1 * n2 * PSI_SCALE, NULL_BINS)
                    yield pd.DataFrame({
                        **{c: part[c].astype(object) for c in CARRIED},
                        "p_raw": p,
                        "tested_delta_psi": seen / (n1 * n2 * PSI_SCALE),
                        "exact": exact,
                        "n_splits": pd.array(
                            [null.shape[1] if exact else None] * len(part), dtype="Int64"),
                        "null_hist": hist.tolist(),
                    })

    return run


def event_inputs(events: DataFrame) -> DataFrame:
    """Skipped-exon events with usable PSI values in both groups."""
    scaled = F.transform(
        F.concat("psi_1", "psi_2"), lambda v: F.round(v * PSI_SCALE).cast("bigint"))
    return (
        events.where(F.col("event_type") == "SE")
        .select("event_id", "gene_symbol", "inc_level_difference",
                psi_list(F.col("inc_level_1")).alias("psi_1"),
                psi_list(F.col("inc_level_2")).alias("psi_2"))
        .where((F.size("psi_1") > 0) & (F.size("psi_2") > 0))
        .select(
            "event_id", "gene_symbol",
            F.coalesce("inc_level_difference", mean(F.col("psi_1")) - mean(F.col("psi_2")))
            .alias("delta"),
            F.size("psi_1").alias("n1"), F.size("psi_2").alias("n2"),
            scaled.alias("pool"),
        )
    )


def event_permutations(
    events: DataFrame, iterations: int = 500, seed: int = 42,
    max_splits: int = EXACT_MAX_SPLITS,
) -> DataFrame:
    """One row per tested event.

    The displayed effect is the caller's where present, the tested one is always
    recomputed.  Few replicates: every label split is enumerated and p = hits / N.
    Otherwise K random splits and p = (hits + 1) / (K + 1).  Splits whose absolute
    difference equals the observed one count as hits.
    """
    inputs = event_inputs(events)
    id_type = inputs.schema["event_id"].dataType.simpleString()
    # the event's key: the first 60 bits of its id's digest
    key = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    tested = inputs.select(*CARRIED, "pool", F.coalesce(key, F.lit(0)).alias("key")).mapInPandas(
        _event_tests(clamped_iterations(iterations), seed, max_splits),
        f"event_id {id_type}, gene_symbol string, delta double, n1 int, n2 int, p_raw double, "
        "tested_delta_psi double, exact boolean, n_splits bigint, null_hist array<bigint>",
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(EVENT_BINS - 1)),
        lambda i: F.get("null_hist", i * 2) + F.get("null_hist", i * 2 + 1))
    return tested.select(
        "event_id", "gene_symbol",
        F.round("delta", 4).alias("observed_delta_psi"), F.col("delta").alias("observed_raw"),
        "tested_delta_psi",
        F.round("p_raw", 4).alias("empirical_p_value"), "n1", "n2", "exact", "n_splits",
        pairs.alias("event_hist"), "null_hist",
    )


# -- summaries -----------------------------------------------------------------------
def null_histogram(results: DataFrame) -> DataFrame:
    """All null values of all events in 40 bins: per-event counts are added up."""
    return results.select(F.posexplode("null_hist").alias("bin", "n")).groupBy("bin").agg(
        F.sum("n").alias("n")
    ).select("bin", histogram_edge(F.col("bin"), NULL_BINS, -1.0, 1.0).alias("edge"), "n")


def observed_histogram(results: DataFrame, column: str = "observed_raw") -> DataFrame:
    every = results.sparkSession.range(NULL_BINS).select(F.col("id").cast("int").alias("bin"))
    found = results.where(F.col(column).isNotNull()).groupBy(
        histogram_bin(F.col(column), NULL_BINS, -1.0, 1.0).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "bin", "left").select(
        "bin", histogram_edge(F.col("bin"), NULL_BINS, -1.0, 1.0).alias("edge"),
        F.coalesce("n", F.lit(0)).alias("n"))


def shares(results: DataFrame) -> DataFrame:
    """One row: tested events, % with p < 0.05 and 0.01 (on rounded p), exact share."""
    pct = lambda cond: F.round(F.try_divide(
        F.count_if(cond) * F.lit(100.0), F.count(F.lit(1))), 1)
    p = F.col("empirical_p_value")
    return results.agg(
        F.count(F.lit(1)).alias("n_events_tested"),
        pct(p < 0.05).alias("pct_p05"), pct(p < 0.01).alias("pct_p01"),
        F.round(F.avg(F.col("exact").cast("int")), 4).alias("exact_fraction"),
    )


def modal_design(
    results: DataFrame, iterations: int = 500, max_splits: int = EXACT_MAX_SPLITS
) -> DataFrame:
    """Most common (n1, n2) and the smallest p it can reach."""
    counted = results.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.min(F.struct(-F.col("n"), "n1", "n2")).alias("d"))
    splits = binomial(F.col("d.n1") + F.col("d.n2"), F.col("d.n1"))
    return top.select(
        F.col("d.n1").alias("n_replicates_g1"), F.col("d.n2").alias("n_replicates_g2"),
        F.when(splits <= max_splits, 1.0 / splits)
        .otherwise(F.lit(1.0 / (clamped_iterations(iterations) + 1))).alias("min_p_attainable"),
    )


def permutation_summary(results: DataFrame, iterations: int = 500) -> DataFrame:
    """Shares and design side by side."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(shares(results)).join(one(modal_design(results, iterations)), "_one").drop("_one")


def significant_view(results: DataFrame, events: DataFrame, significant: Column) -> DataFrame:
    """Results of the significant events only."""
    ids = events.where(significant).select("event_id")
    return results.join(ids, "event_id", "left_semi")


def convergence_table(events: DataFrame, seed: int = 42) -> DataFrame:
    """The shares at growing K, or one row when every design was enumerated."""

    def row(k: int) -> DataFrame:
        results = event_permutations(events, k, seed)
        return permutation_summary(results, k).select(
            F.lit(k).alias("iterations"), F.lit(None).cast("string").alias("label"), "*")

    reference = materialize(row(CONVERGENCE[-1]), "convergence")
    if reference.where("exact_fraction = 1.0").isEmpty():
        earlier = [row(k) for k in CONVERGENCE[:-1]]
        return reduce(DataFrame.unionByName, [*earlier, reference])
    return reference.withColumn("label", F.lit("exact enumeration (all label permutations)"))


# -- metrics split by the sign of the effect --------------------------------------------
METRICS = ["ppt_score", "exon_size", "frame_in_frame", "canonical_sites"]


def metric_values(results: DataFrame, features: DataFrame) -> DataFrame:
    """Long (metric, value, first) where `first` marks events with a positive effect;
    events without effect sign or without features take no part."""
    frame = F.col("frame_class")
    flags = F.array_compact(F.array(
        F.col("donor_is_gt").cast("int"), F.col("acceptor_is_ag").cast("int")))
    values = {
        "ppt_score": F.col("ppt_score"),
        "exon_size": F.col("exon_size").cast("double"),
        "frame_in_frame": F.when(
            frame.isNotNull() & (frame != "unknown"),
            (frame == "in_frame").cast("int").cast("double")),
        "canonical_sites": mean(flags),
    }
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in METRICS])
    signed = results.where("observed_raw <> 0").select(
        "event_id", (F.col("observed_raw") > 0).alias("first"))
    return signed.join(features, "event_id").select("first", F.inline(rows)).where(
        "value IS NOT NULL")


def metric_distribution(values: DataFrame) -> DataFrame:
    """Counts per distinct value and side; exon sizes min-max normalised over all.

    A random relabelling only needs these counts: drawing n1 of N rows without
    replacement draws from the distinct values by the multivariate hypergeometric
    law.  The four metrics have bounded domains, so this table stays small however
    many events there are.
    """
    counted = values.groupBy("metric", "value").agg(
        F.count_if("first").alias("n_first"), F.count_if(~F.col("first")).alias("n_second"))
    span = counted.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    return counted.join(span, "metric").select(
        "metric", F.when(F.col("metric") == "exon_size", scaled).otherwise(F.col("value"))
        .alias("value"), "n_first", "n_second")


def _draw_sums(values: np.ndarray, counts: np.ndarray, n1: int, k: int, rng) -> np.ndarray:
    """k sums of n1 items drawn without replacement from counted values.

    Binomial draws per value, then the surplus (or the lack) is taken back from (or
    added to) the drawn (or undrawn) items uniformly: together an exact draw, for
    populations of any size.
    """
    total = int(counts.sum())
    out = np.empty(k)
    for i in range(k):
        drawn = rng.binomial(counts, n1 / total)
        gap = int(drawn.sum()) - n1
        if gap:
            source = drawn if gap > 0 else counts - drawn
            edges = np.cumsum(source)
            picked: set[int] = set()
            while len(picked) < abs(gap):
                more = rng.integers(0, int(edges[-1]), abs(gap) - len(picked))
                picked.update(more.tolist())
            at = np.searchsorted(edges, np.fromiter(picked, dtype=np.int64), side="right")
            change = np.bincount(at, minlength=len(counts))
            drawn = drawn - change if gap > 0 else drawn + change
        out[i] = float(values @ drawn)
    return out


def _metric_null(iterations: int, seed: int, max_splits: int, blocks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        metric, block = pdf["metric"].iat[0], int(pdf["block"].iat[0])
        values = pdf["value"].to_numpy(float)
        n1, n2 = int(pdf["n_first"].sum()), int(pdf["n_second"].sum())
        counts = (pdf["n_first"] + pdf["n_second"]).to_numpy(np.int64)
        total = float(values @ counts)
        empty = pd.DataFrame({
            "metric": pd.Series([], dtype=object), "null": pd.Series([], dtype=float),
            "exact": pd.Series([], dtype=bool)})
        if n1 == 0 or n2 == 0 or n1 + n2 < 4:
            return empty
        # more items than max_splits mean more splits too: no need for the big product
        if n1 + n2 <= max_splits and math.comb(n1 + n2, n1) <= max_splits:
            if block:
                return empty
            sums, exact = _splits(n1 + n2, n1) @ np.repeat(values, counts), True
        else:
            k = iterations // blocks + (block < iterations % blocks)
            rng = np.random.default_rng([seed, METRICS.index(metric), block])
            sums, exact = _draw_sums(values, counts, n1, k, rng), False
        return pd.DataFrame(
            {"metric": pd.Series([metric] * len(sums), dtype=object), "null": sums / n1 - (total - sums) / n2, "exact": exact})

    return run


def metric_permutations(
    distribution: DataFrame, iterations: int = 500, seed: int = 42,
    max_splits: int = EXACT_MAX_SPLITS, blocks: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(results, null values): statistic mean(effect > 0) - mean(effect < 0)."""
    k = clamped_iterations(iterations)
    spread = distribution.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    null = materialize(
        spread.groupBy("metric", "block").applyInPandas(
            _metric_null(k, seed, max_splits, blocks),
            "metric string, null double, exact boolean"),
        "metric-null")
    sides = distribution.groupBy("metric").agg(
        F.sum("n_first").alias("n_g2"), F.sum("n_second").alias("n_g1"),
        F.try_divide(F.sum(F.col("value") * F.col("n_first")), F.sum("n_first")).alias("_m2"),
        F.try_divide(F.sum(F.col("value") * F.col("n_second")), F.sum("n_second")).alias("_m1"),
    )
    frame = distribution.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    known = frame.join(sides, "metric", "left").na.fill(0, ["n_g1", "n_g2"]).withColumn(
        "_obs", F.when((F.col("n_g1") > 0) & (F.col("n_g2") > 0)
                       & (F.col("n_g1") + F.col("n_g2") >= 4), F.col("_m2") - F.col("_m1")))
    # a split equal to the observed one up to summation error counts as a hit
    hits = null.join(known.select("metric", "_obs"), "metric").groupBy("metric").agg(
        F.count_if(F.abs("null") >= F.abs("_obs") - 1e-12).alias("_r"),
        F.count(F.lit(1)).alias("_k"), F.max("exact").alias("exact"))
    p = F.when(F.col("exact"), F.col("_r") / F.col("_k")).otherwise(
        (F.col("_r") + 1) / (F.col("_k") + 1))
    results = known.join(hits, "metric", "left").select(
        "metric", F.round("_obs", 4).alias("observed_stat"),
        F.round(p, 4).alias("empirical_p_value"),
        (F.col("n_g1") + F.col("n_g2")).alias("n_valid"), "n_g1", "n_g2",
        F.coalesce("exact", F.lit(False)).alias("exact"),
        F.when(F.col("exact"), F.col("_k")).alias("n_splits"))
    return results, null


def metric_histograms(null: DataFrame) -> DataFrame:
    return null.groupBy(
        "metric", histogram_bin(F.col("null"), METRIC_BINS, -1.0, 1.0).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "edge", histogram_edge(F.col("bin"), METRIC_BINS, -1.0, 1.0))
