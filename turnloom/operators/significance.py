"""Significance tests from aggregated counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.stats import chi2_p_value, exact_rank_sum_p_value, two_sided_p_value


def pattern_chi_square(counts: DataFrame, n_groups: DataFrame, family: Sequence[str],
                       min_total: int = 1) -> DataFrame:
    """Chi-square of [this n-gram, every other n-gram] across all groups of a family.

    `n_groups` gives how many groups a family has, including any without n-grams: such a
    group has expected counts of zero, and then the family has no valid test. Two groups get
    the continuity correction.
    """
    family = list(family)
    totals = counts.groupBy(*family, "group").agg(F.sum("cnt").alias("n_g"))
    sizes = (
        totals.groupBy(*family)
        .agg(F.sum("n_g").alias("grand"), F.count("*").alias("_filled"))
        .join(n_groups, family)
        .filter((F.col("_filled") == F.col("n_groups")) & (F.col("n_groups") > 1))
    )
    c, n_g, total, grand = F.col("cnt"), F.col("n_g"), F.col("total"), F.col("grand")
    per_ngram = (
        counts.join(totals, [*family, "group"])
        .groupBy(*family, "ngram")
        .agg(F.sum("cnt").alias("total"), F.sum(c * c / n_g).alias("_squares"),
             F.max(F.struct(c.alias("c"), n_g.alias("n_g"))).alias("_one"))
        .filter(total >= min_total)
        .join(sizes, family)
        .filter(total < grand)
    )
    plain = F.greatest(
        grand * grand / (total * (grand - total)) * (F.col("_squares") - total * total / grand),
        F.lit(0.0),
    )
    deviation = F.abs(F.col("_one.c") - total * F.col("_one.n_g") / grand)
    shrink = (deviation - F.least(F.lit(0.5), deviation)) / deviation
    corrected = F.when(deviation == 0, 0.0).otherwise(plain * shrink * shrink)
    dof = F.col("n_groups") - 1
    return per_ngram.select(
        *family, "ngram", "total",
        F.when(F.col("n_groups") == 2, corrected).otherwise(plain).alias("chi2"),
        dof.alias("dof"),
    ).withColumn("p_value", chi2_p_value("chi2", "dof"))


def indicator_rank_test(counts: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Mann-Whitney U of 0/1 indicators of each label in two splits, from four counts.

    `counts` has one row per (keys, split, label, cnt).
    """
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("split") == first, F.col("cnt")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("split") == second, F.col("cnt")).otherwise(0)).alias("n2"),
    )
    ones = counts.groupBy(*keys, "label").agg(
        F.sum(F.when(F.col("split") == first, F.col("cnt")).otherwise(0)).alias("k1"),
        F.sum(F.when(F.col("split") == second, F.col("cnt")).otherwise(0)).alias("k2"),
    )
    rows = ones.join(F.broadcast(sizes), keys).withColumns(
        {name: F.col(name).cast("double") for name in ("k1", "k2", "n1", "n2")})
    n1, n2, k1, k2 = (F.col(c) for c in ("n1", "n2", "k1", "k2"))
    n, o = n1 + n2, k1 + k2
    z = n - o
    rank_sum = (n1 - k1) * (z + 1) / 2 + k1 * (z + (o + 1) / 2)
    rows = rows.withColumn("u", rank_sum - n1 * (n1 + 1) / 2)
    ties = z * z * z - z + o * o * o - o
    return _asymptotic(rows, n1, n2, ties)


def _asymptotic(rows: DataFrame, n1: Column, n2: Column, ties: Column) -> DataFrame:
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    larger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    score = (larger - n1 * n2 / 2 - 0.5) / F.sqrt(variance)
    return rows.withColumn("z", F.when(variance > 1e-9, score)).withColumn(
        "p_value", two_sided_p_value("z"))


def rank_test(values: DataFrame, keys: Sequence[str], value: str, important: Column) -> DataFrame:
    """Mann-Whitney U of `value` between important rows and the others, with average ranks
    from the counts of distinct values, and summary statistics of both sides.

    The exact distribution is used for a side of at most eight values without any tie.
    """
    keys = list(keys)
    counts = values.groupBy(*keys, value).agg(
        F.count_if(important).alias("_x"), F.count_if(~important).alias("_y"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    both = F.col("_x") + F.col("_y")
    ranked = counts.withColumn(
        "_rank", F.coalesce(F.sum(both).over(w), F.lit(0)) + (both + 1) / 2.0)
    tests = ranked.groupBy(*keys).agg(
        F.sum("_x").cast("double").alias("n1"), F.sum("_y").cast("double").alias("n2"),
        F.sum(F.col("_x") * F.col("_rank")).alias("_r1"),
        F.sum(both * both * both - both).cast("double").alias("_ties"),
    ).withColumn("u", F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n1, n2 = F.col("n1"), F.col("n2")
    enough = (n1 >= 2) & (n2 >= 2)
    tests = _asymptotic(tests, n1, n2, F.col("_ties"))
    exact = (F.col("_ties") == 0) & (F.least(n1, n2) <= 8)
    tests = tests.withColumns({
        "u": F.when(enough, F.col("u")),
        "p_value": F.when(enough, F.when(
            exact, exact_rank_sum_p_value(F.when(exact & enough, F.col("u")), n1, n2)
        ).otherwise(F.col("p_value"))),
    })
    side = lambda c: F.when(c, F.col(value))
    summary = values.groupBy(*keys).agg(*[
        measure
        for name, cond in (("important", important), ("other", ~important))
        for measure in (
            F.avg(side(cond)).alias(f"mean_{name}"),
            F.percentile(side(cond), 0.5).alias(f"median_{name}"),
            F.max(side(cond)).alias(f"max_{name}"),
        )
    ])
    return tests.join(summary, keys).drop("_r1", "_ties", "z")


def log_p_matrix(pairs: DataFrame, keys: Sequence[str], p: str = "p_fdr", level: float = 0.05) -> DataFrame:
    """-log10 of corrected p for both orders of each pair, with a flag at the level."""
    both = pairs.filter(F.col(p).isNotNull()).select(
        *keys, F.inline(F.array(
            F.struct(F.col("a").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
        )), p)
    value = -F.log10(F.greatest(F.col(p), F.lit(1e-10)))
    return both.withColumn("neg_log10_p", value).withColumn(
        "starred", F.col("neg_log10_p") >= -F.log10(F.lit(level))).drop(p)
