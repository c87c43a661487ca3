"""Comparisons of every pair of groups from sparse counts.

Input is one aggregated row per (keys, group, feature). Only features that both groups of a
pair have meet in a join; what just one side has enters through per-group totals, so no
zero-filled matrix is built and chi-square and divergence still cover the whole vocabulary.
Results have one row per pair by definition, so callers pass groups that are a set of names
(codes, therapists, classes) or, where the question is about sessions, accept one row per
pair of sessions within their key. `keys` is never empty: pairs meet on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_SMOOTHING = 1e-10
FREQUENCY_SMOOTHING = 1e-9


def _sides(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
           measures: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    def side(name: str) -> DataFrame:
        return counts.select(
            *keys, F.col(feature).alias("_feature"), F.col(group).alias(name),
            *[F.col(m).alias(f"{m}_{name}") for m in measures],
        )

    return side("a"), side("b")


def shared_features(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
                    measures: Sequence[str]) -> DataFrame:
    """Features present on both sides of each pair a < b."""
    a, b = _sides(counts, keys, group, feature, measures)
    return a.join(b, [*keys, "_feature"]).filter(F.col("a") < F.col("b"))


def all_pairs(groups: DataFrame, keys: Sequence[str], group: str, *measures: str) -> DataFrame:
    """Every pair a < b of the groups sharing a key, with both sides' measures."""

    def side(name: str) -> DataFrame:
        return groups.select(
            *keys, F.col(group).alias(name), *[F.col(m).alias(f"{m}_{name}") for m in measures])

    return side("a").join(side("b"), list(keys)).filter(F.col("a") < F.col("b"))


def cosine(freq: DataFrame, keys: Sequence[str], group: str, feature: str,
           value: str) -> DataFrame:
    """Cosine similarity of group vectors; pairs without a shared feature score 0."""
    v = F.col(value)
    norms = freq.groupBy(*keys, group).agg(F.sqrt(F.sum(v * v)).alias("norm"))
    dots = (
        shared_features(freq, keys, group, feature, [value])
        .groupBy(*keys, "a", "b")
        .agg(F.sum(F.col(f"{value}_a") * F.col(f"{value}_b")).alias("dot"))
    )
    return (
        all_pairs(norms, keys, group, "norm")
        .join(dots, [*keys, "a", "b"], "left")
        .withColumn("cosine", F.coalesce(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), F.lit(0.0)))
    )


def _log(x: Column, base2: bool) -> Column:
    return F.log2(x) if base2 else F.log(x)


def _js_term(p: Column, q: Column, base2: bool) -> Column:
    m = p + q
    return 0.5 * p * _log(2.0 * p / m, base2) + 0.5 * q * _log(2.0 * q / m, base2)


def frequency_divergence(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
                         value: str, base2: bool = True,
                         smoothing: float = FREQUENCY_SMOOTHING) -> DataFrame:
    """Jensen-Shannon divergence of shares, with `smoothing` added to every share over the
    vocabulary all groups of a key have in union.

    A feature a group lacks has the same smoothed share in every group of the key, so the
    term of a one-sided feature depends on its own group alone and is summed per group.
    """
    totals = counts.groupBy(*keys, group).agg(F.sum(value).alias("_total"))
    vocabulary = counts.groupBy(*keys).agg(F.countDistinct(feature).alias("_vocabulary"))
    scale = 1.0 + F.col("_vocabulary") * smoothing
    share = F.col(value) / F.col("_total") + smoothing
    smoothed = (
        counts.join(totals, [*keys, group]).join(vocabulary, list(keys))
        .withColumn("_p", share / scale)
        .withColumn("_alone", _js_term(F.col("_p"), smoothing / scale, base2))
    )
    alone = smoothed.groupBy(*keys, group).agg(F.sum("_alone").alias("alone"))
    met = (
        shared_features(smoothed, keys, group, feature, ["_p", "_alone"])
        .groupBy(*keys, "a", "b")
        .agg(F.sum(
            _js_term(F.col("_p_a"), F.col("_p_b"), base2) - F.col("_alone_a") - F.col("_alone_b")
        ).alias("met"))
    )
    js = F.col("alone_a") + F.col("alone_b") + F.coalesce(F.col("met"), F.lit(0.0))
    return (
        all_pairs(alone, keys, group, "alone")
        .join(met, [*keys, "a", "b"], "left")
        .withColumn("js", F.greatest(js, F.lit(0.0)))
        .drop("alone_a", "alone_b", "met")
    )


def count_tests(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
                value: str) -> DataFrame:
    """Chi-square and natural-log Jensen-Shannon divergence of each pair from raw counts.

    `chi2` is that of the 2 x m table over features either side has, with `dof` m - 1 and the
    continuity correction for 2 x 2; both are null with fewer than two features.

    `js` adds a tiny constant to every count. A one-sided feature then has share
    q = constant / total on the other side. To first order in q, which is exact here, its
    terms add up to (ln 2 * p + q * (ln 2 + ln q - 1 - ln p)) / 2, so share, count and log
    sums per group are enough. The constant's own weight in the totals is below 1e-9 and left
    out.
    """
    totals = counts.groupBy(*keys, group).agg(F.sum(value).alias("_total"))
    share = (F.col(value) + COUNT_SMOOTHING) / F.col("_total")
    shares = counts.join(totals, [*keys, group]).withColumn("_p", share).withColumn("_ln", F.log("_p"))
    groups = shares.groupBy(*keys, group).agg(
        F.sum(value).alias("size"), F.count("*").alias("features"),
        F.sum("_p").alias("mass"), F.sum("_ln").alias("logs"))
    x, y = F.col(f"{value}_a"), F.col(f"{value}_b")
    met = (
        shared_features(shares, keys, group, feature, [value, "_p", "_ln"])
        .groupBy(*keys, "a", "b")
        .agg(
            F.count("*").alias("shared"), F.sum(x).alias("shared_a"), F.sum(y).alias("shared_b"),
            F.sum(x * x / (x + y)).alias("square_a"), F.sum(y * y / (x + y)).alias("square_b"),
            F.max_by(x, x + y).alias("corner"), F.max(x + y).alias("corner_total"),
            F.sum(_js_term(F.col("_p_a"), F.col("_p_b"), False)).alias("met"),
            *[F.sum(f"_p_{s}").alias(f"met_mass_{s}") for s in "ab"],
            *[F.sum(f"_ln_{s}").alias(f"met_logs_{s}") for s in "ab"],
        )
    )
    pairs = all_pairs(groups, keys, group, "size", "features", "mass", "logs").join(
        met, [*keys, "a", "b"], "left")
    zero = F.lit(0.0)
    n_a, n_b = F.col("size_a"), F.col("size_b")
    total = n_a + n_b

    part_a = (n_a - F.coalesce(F.col("shared_a"), zero) + F.coalesce(F.col("square_a"), zero)) / n_a
    part_b = (n_b - F.coalesce(F.col("shared_b"), zero) + F.coalesce(F.col("square_b"), zero)) / n_b
    plain = F.greatest(total * (part_a + part_b - 1.0), zero)
    columns = F.col("features_a") + F.col("features_b") - F.coalesce(F.col("shared"), F.lit(0))
    # 2 x 2: every |O - E| is equal; one cell of a shared column gives it, and with no shared
    # column the table is diagonal.
    deviation = F.coalesce(
        F.abs(F.col("corner") - F.col("corner_total") * n_a / total), n_a * n_b / total)
    shrunk = (deviation - F.least(F.lit(0.5), deviation)) / deviation
    corrected = F.when(deviation == 0, zero).otherwise(plain * shrunk * shrunk)
    chi2 = F.when(columns == 2, corrected).when(columns > 2, plain)

    ln2 = math.log(2.0)

    def alone(side: str, other: str) -> Column:
        mass = F.col(f"mass_{side}") - F.coalesce(F.col(f"met_mass_{side}"), zero)
        logs = F.col(f"logs_{side}") - F.coalesce(F.col(f"met_logs_{side}"), zero)
        k = F.col(f"features_{side}") - F.coalesce(F.col("shared"), zero)
        q = COUNT_SMOOTHING / F.col(f"size_{other}")
        return F.when(k > 0, 0.5 * (ln2 * mass + q * (k * (ln2 + F.log(q) - 1.0) - logs))).otherwise(zero)

    js = F.coalesce(F.col("met"), zero) + alone("a", "b") + alone("b", "a")
    return pairs.select(
        *keys, "a", "b", n_a.alias("n_a"), n_b.alias("n_b"), chi2.alias("chi2"),
        F.when(columns >= 2, columns - 1).alias("dof"), F.greatest(js, zero).alias("js"))


def count_divergence(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
                     value: str, base2: bool = False) -> DataFrame:
    """Jensen-Shannon divergence of raw counts, see `count_tests`."""
    scale = math.log(2.0) if base2 else 1.0
    return count_tests(counts, keys, group, feature, value).select(
        *keys, "a", "b", (F.col("js") / scale).alias("js"))


def chi_square(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
               value: str) -> DataFrame:
    """Chi-square of the 2 x m table of each pair, see `count_tests`."""
    return count_tests(counts, keys, group, feature, value).drop("js")


def tests_against_rest(counts: DataFrame, keys: Sequence[str], group: str, feature: str,
                       value: str) -> DataFrame:
    """`count_tests` of each group against all other groups of its key pooled, one row per group.

    The others are the key's total minus the group's own counts. A feature the group lacks adds
    its whole share to what the others have alone, so only features the group has are read: the
    work grows with the counts, not with groups times vocabulary. A key's only group has nothing
    to meet.
    """
    keys = list(keys)
    total = counts.groupBy(*keys, feature).agg(F.sum(value).alias("_column"))
    whole = total.groupBy(*keys).agg(F.sum("_column").alias("_all"), F.count("*").alias("_columns"))
    sizes = counts.groupBy(*keys, group).agg(F.sum(value).alias("n_a"))
    x, column, size, everything = F.col(value), F.col("_column"), F.col("n_a"), F.col("_all")
    y, rest = column - x, everything - size
    p, q = x / size, y / rest
    shared = F.when(y > 0, 0.5 * (p * F.log((p + q) / p) + q * F.log((p + q) / q))).otherwise(0.0)
    own = (
        counts.join(total, [*keys, feature]).join(sizes, [*keys, group]).join(whole, keys)
        .filter(rest > 0)
        .groupBy(*keys, group, "n_a", "_all", "_columns")
        .agg(F.sum(x * x / column).alias("_square_a"), F.sum(y * y / column).alias("_square_b"),
             F.sum(y).alias("_met_b"), F.max_by(x, column).alias("_corner"),
             F.max(column).alias("_corner_column"), F.sum(shared).alias("_shared"))
    )
    plain = F.greatest(everything * (
        F.col("_square_a") / size + (rest - F.col("_met_b") + F.col("_square_b")) / rest - 1.0), F.lit(0.0))
    deviation = F.abs(F.col("_corner") - F.col("_corner_column") * size / everything)
    shrunk = (deviation - F.least(F.lit(0.5), deviation)) / deviation
    corrected = F.when(deviation == 0, 0.0).otherwise(plain * shrunk * shrunk)
    columns = F.col("_columns")
    return own.select(
        *keys, group, size, rest.alias("n_b"),
        F.when(columns == 2, corrected).when(columns > 2, plain).alias("chi2"),
        F.when(columns >= 2, columns - 1).alias("dof"),
        F.greatest(math.log(2.0) - F.col("_shared"), F.lit(0.0)).alias("js"))
