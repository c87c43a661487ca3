"""Distribution tails as vectorised functions, and false-discovery correction.

The tails run on aggregated results only (one row per test). For whole degrees of freedom
the chi-square tail is a finite sum on top of exp or erfc.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from turnloom.session import write_table

_LONG_SUM = 5000  # degrees of freedom beyond which series and continued fraction are shorter


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x), dtype=float, count=len(x))


def _upper_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function for large a: series below a, fraction above."""
    x = np.asarray(x, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = (x - a) / a
        log_front = (-a * (part - np.log1p(part)) - 0.5 * math.log(2.0 * math.pi * a)
                     - 1.0 / (12.0 * a) + 1.0 / (360.0 * a ** 3))
        front = np.where(x > 0, np.exp(log_front), 0.0)  # x**a exp(-x) / gamma(a + 1)
    out = np.ones_like(x)
    low = x < a + 1
    if low.any():
        y, term, n = x[low], np.ones(low.sum()), 0
        total = term.copy()
        while (term > 1e-17 * total).any():
            n += 1
            term = term * y / (a + n)
            total += term
        out[low] = 1.0 - front[low] * total
    if (~low).any():
        y = x[~low]
        b, c = y + 1.0 - a, np.full(y.shape, 1e300)
        d = 1.0 / b
        h, n, change = d.copy(), 0, np.full(y.shape, 2.0)
        while (np.abs(change - 1.0) > 1e-15).any() and n < 10_000_000:
            n += 1
            an = -n * (n - a)
            b = b + 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            change = c * d
            h = h * change
        out[~low] = front[~low] * a * h
    return np.clip(out, 0.0, 1.0)


def _tail_for_dof(x: np.ndarray, dof: int) -> np.ndarray:
    half = x / 2.0
    if dof > _LONG_SUM:
        return _upper_gamma(0.5 * dof, half)
    odd = dof % 2
    tail = _erfc(np.sqrt(half)) if odd else np.zeros_like(half)
    with np.errstate(divide="ignore"):
        log_half = np.log(half)
    for step in range(dof // 2):
        power = step + 0.5 * odd
        if power == 0:
            tail = tail + np.exp(-half)
        else:
            tail = tail + np.exp(power * log_half - half - math.lgamma(power + 1.0))
    return np.clip(tail, 0.0, 1.0)


def chi2_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(X >= x) for a chi-square variable; nan where an input is missing."""
    x = np.asarray(x, dtype=float)
    dof = np.asarray(dof, dtype=float)
    out = np.full(x.shape, np.nan)
    known = ~(np.isnan(x) | np.isnan(dof)) & (dof >= 1)
    for d in np.unique(dof[known]):
        rows = known & (dof == d)
        out[rows] = _tail_for_dof(x[rows], int(d))
    return out


def _nullable(p: np.ndarray) -> pd.Series:
    series = pd.Series(p)
    return series.astype(object).where(series.notna(), None)


def _chi2_p(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return _nullable(chi2_tail(chi2.to_numpy(dtype=float), dof.to_numpy(dtype=float)))


def _two_sided_p(z: pd.Series) -> pd.Series:
    values = z.to_numpy(dtype=float)
    tail = np.minimum(_erfc(np.nan_to_num(values) / math.sqrt(2.0)), 1.0)
    return _nullable(np.where(np.isnan(values), np.nan, tail))


def exact_rank_sum_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact Mann-Whitney p for samples without ties."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    # Gaussian binomial coefficient, one factor (1 - q^(n2+i)) / (1 - q^i) at a time
    for i in range(1, n1 + 1):
        for k in range(counts.size - 1, n2 + i - 1, -1):
            counts[k] -= counts[k - n2 - i]
        for k in range(i, counts.size):
            counts[k] += counts[k - i]
    larger = max(u, n1 * n2 - u)
    tail = counts[int(math.ceil(larger)):].sum() / counts.sum()
    return float(min(1.0, 2.0 * tail))


def _exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(value) else exact_rank_sum_p(value, int(a), int(b))
        for value, a, b in zip(u, n1, n2)
    ], dtype=object)


# The functions are wrapped at each use: a wrapper kept in the module would hold on to the
# session that saw it first.

def chi2_p_value(chi2: str, dof: str) -> Column:
    return F.pandas_udf(_chi2_p, DoubleType())(chi2, dof)


def two_sided_p_value(z: str) -> Column:
    """2 * P(Z >= z), at most 1."""
    return F.pandas_udf(_two_sided_p, DoubleType())(z)


def exact_rank_sum_p_value(u: Column, n1: Column, n2: Column) -> Column:
    return F.pandas_udf(_exact_p, DoubleType())(u, n1, n2)


def benjamini_hochberg(df: DataFrame, family: Sequence[str], p: str = "p_value",
                       level: float = 0.05) -> DataFrame:
    """Add `p_fdr` and `significant` within each family; missing p stays missing.

    Equal p-values collapse to one row, and ranks and minima run inside value buckets that
    one summary row per bucket connects, so a family may hold any number of tests. The tests
    are written first, because four branches of the plan read them.
    """
    family = list(family)
    df = write_table(df.sparkSession, "tests", df)
    value = F.col(p)
    bucket = F.when(value >= 0.01, F.floor(value * 1000)).otherwise(
        F.floor(F.log10(F.greatest(value, F.lit(1e-300))) * 16))
    distinct = (
        df.filter(value.isNotNull()).groupBy(*family, p)
        .agg(F.count("*").alias("_tests")).withColumn("_bucket", bucket.cast("long"))
    )
    per_bucket = Window.partitionBy(*family).orderBy("_bucket")
    offsets = distinct.groupBy(*family, "_bucket").agg(F.sum("_tests").alias("_n")).select(
        *family, "_bucket",
        F.coalesce(F.sum("_n").over(per_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"),
        F.sum("_n").over(Window.partitionBy(*family)).alias("_all"),
    )
    inside = Window.partitionBy(*family, "_bucket")
    ranked = distinct.join(offsets, [*family, "_bucket"]).withColumn(
        "_q",
        value * F.col("_all") / (F.col("_before") + F.sum("_tests").over(
            inside.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow))),
    )
    later = (
        Window.partitionBy(*family).orderBy(F.col("_bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    minima = ranked.groupBy(*family, "_bucket").agg(F.min("_q").alias("_q")).select(
        *family, "_bucket", F.min("_q").over(later).alias("_later"))
    adjusted = ranked.join(minima, [*family, "_bucket"]).select(
        *family, p,
        F.least(
            F.min("_q").over(inside.orderBy(value.desc()).rowsBetween(
                Window.unboundedPreceding, Window.currentRow)),
            F.col("_later"),
            F.lit(1.0),
        ).alias("p_fdr"),
    )
    return df.join(adjusted, [*family, p], "left").withColumn(
        "significant", F.coalesce(F.col("p_fdr") < level, F.lit(False)))
