"""Distribution tails (small result tables only) and binning arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|).  Spark SQL has no erf, so this runs on result rows."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2.0)))


def _beta_fraction(x: float, a: float, b: float) -> float | None:
    """Continued fraction of the incomplete beta integral, evaluated by the
    forward convergent recurrence with rescaling; None when it does not settle."""
    num_prev, num, den_prev, den = 1.0, 1.0, 0.0, 1.0
    ratio = 1.0
    for j in range(1, 2 * 20000):
        m = j // 2
        if j % 2:
            coef = -(a + m) * (a + b + m) * x / ((a + j - 1) * (a + j))
        else:
            coef = m * (b - m) * x / ((a + j - 1) * (a + j))
        num, num_prev = num + coef * num_prev, num
        den, den_prev = den + coef * den_prev, den
        if den:
            num, num_prev, den_prev, den = num / den, num_prev / den, den_prev / den, 1.0
            if abs(num - ratio) <= 1e-14 * abs(num) and j > 4:
                return 1.0 / num if num else None
            ratio = num
    return None


def incomplete_beta(x: float, a: float, b: float) -> float | None:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        mirrored = incomplete_beta(1.0 - x, b, a)
        return None if mirrored is None else 1.0 - mirrored
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    tail = _beta_fraction(x, a, b)
    return None if tail is None else math.exp(log_front) / a * tail


def t_two_sided_value(t: float, df: float) -> float | None:
    p = incomplete_beta(df / (df + t * t), df / 2.0, 0.5)
    return None if p is None else min(1.0, p)


@F.pandas_udf(DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) with df degrees of freedom."""
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(d) else t_two_sided_value(float(a), float(d))
            for a, d in zip(t, df, strict=True)
        ],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def hypergeometric_tail(
    total: pd.Series, marked: pd.Series, drawn: pd.Series, hits: pd.Series
) -> pd.Series:
    """P(X >= hits) drawing `drawn` of `total` items of which `marked` count."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])

    def log_comb(n: float, k: np.ndarray) -> np.ndarray:
        return math.lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    out = []
    for n, m, d, k in zip(total, marked, drawn, hits, strict=True):
        lo, hi = max(k, 0, d - (n - m)), min(m, d)
        if hi < lo:
            out.append(0.0)
            continue
        i = np.arange(lo, hi + 1, dtype=float)
        terms = log_comb(m, i) + log_comb(n - m, d - i) - log_comb(n, np.array([float(d)]))
        peak = terms.max()
        out.append(min(1.0, float(np.exp(peak) * np.exp(terms - peak).sum())))
    return pd.Series(out, dtype="float64")


def histogram_bin(value: Column, n_bins: int, lo: float, hi: float) -> Column:
    """Fixed-edge bin index; values outside fall into the edge bins."""
    step = (hi - lo) / n_bins
    index = F.floor((value - F.lit(lo)) / F.lit(step))
    return F.least(F.greatest(index, F.lit(0)), F.lit(n_bins - 1)).cast("int")


def histogram_edge(index: Column, n_bins: int, lo: float, hi: float) -> Column:
    step = (hi - lo) / n_bins
    return F.round(F.lit(lo) + index * F.lit(step), 3)


def size_bucket(size: Column) -> Column:
    """25-nt buckets, everything from 500 up together."""
    return F.least(F.lit(500), F.floor(size / 25) * 25).cast("bigint")


def dpsi_bucket(value: Column) -> Column:
    return F.round(F.floor(value / F.lit(0.1)) * F.lit(0.1), 2)


def binomial(n: Column, k: Column) -> Column:
    """C(n, k) as a running integer product: exact while the result fits a double's
    53 bits, and increasing beyond, which is all a threshold test needs."""
    smaller = F.least(k, n - k)
    steps = F.when(smaller >= 1, F.sequence(F.lit(1), smaller.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(
        steps, F.lit(1.0), lambda acc, i: F.round(acc * (n - smaller + i) / i)
    )
