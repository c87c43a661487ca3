"""How consistently raters label: counts once, then comparisons of raters, codes and rest.

`rater_counts` is the one table every comparison reads: n-gram counts of block and rest
sequences per slice, rater, session and code. n = 1 is the plain label distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.functions.stats import chi2_p_value
from turnloom.operators import blocks as B
from turnloom.operators import nearest as NN
from turnloom.operators import ngrams as N
from turnloom.operators import pairs as P
from turnloom.operators.ordered import Ordering, overall

POOLED = "pooled"


def rater() -> Column:
    return L.therapist_in_prefix(F.col("source_file"))


def with_positives(hub: DataFrame, order: Ordering, target: str) -> DataFrame:
    """Rows of transcripts that have at least one row important to the target."""
    flag = F.when(F.col(f"{target}_start").isNotNull(), 1).otherwise(0)
    return overall(hub, order, {"_any": ("max", flag)}).filter(F.col("_any") == 1).drop("_any")


def block_rows(hub: DataFrame, order: Ordering, target: str, context: int = 0) -> DataFrame:
    """Rows of important blocks by `seq` (block start), with `context` rows either side."""
    if context == 0:
        return B.sequence_rows(hub, target)
    return B.context_rows(hub, order, target, context).withColumn("seq", F.col("block_start"))


def sequence_counts(rows: DataFrame, order: Ordering, granularity: str, sizes: Sequence[int],
                    overlapping: bool = False) -> DataFrame:
    """n-gram counts per (slice, source_file, seq), repeats of a label kept."""
    sliced = B.with_slices(rows).withColumn("label", L.pick_label(granularity))
    keys = ("source_file", "slice", "seq") if overlapping else ("source_file", "slice")
    return N.count_ngrams(N.ngrams(sliced, order.keyed(*keys), sizes), "slice", "source_file", "seq")


def rater_counts(hub: DataFrame, codes: DataFrame, order: Ordering, target: str,
                 granularity: str = "groups", sizes: Sequence[int] = (1, 2, 3),
                 window_size: int | None = None, context: int = 0) -> DataFrame:
    """kind (`code`, `important`, `rest`), slice, rater, source_file, code, n, ngram, cnt.

    A block counts once under `important` and once under each of its codes.
    """
    kept = with_positives(hub, order, target)
    important = sequence_counts(
        block_rows(kept, order, target, context), order, granularity, sizes, context > 0)
    rest = sequence_counts(B.rest_windows(kept, target, window_size), order, granularity, sizes)
    none = F.lit(None).cast("string")
    parts = [
        N.spread_over_codes(important, codes).withColumn("kind", F.lit("code")),
        important.withColumns({"kind": F.lit("important"), "code": none}),
        rest.withColumns({"kind": F.lit("rest"), "code": none}),
    ]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        everything.withColumn("rater", rater())
        .groupBy("kind", "slice", "rater", "source_file", "code", "n", "ngram")
        .agg(F.sum("cnt").alias("cnt"))
    )


def rater_sequences(hub: DataFrame, codes: DataFrame, order: Ordering, target: str,
                    window_size: int | None = None, context: int = 0) -> DataFrame:
    """Number of sequences per kind, slice, rater, session and code.

    A block counts in a speaker's slice only where that speaker has a row in it; a rest
    sequence counts in every slice.
    """
    kept = with_positives(hub, order, target)
    important = B.with_slices(block_rows(kept, order, target, context)).select(
        "source_file", "slice", "seq").distinct()
    rest = (
        B.rest_windows(kept, target, window_size).select("source_file", "seq").distinct()
        .withColumn("slice", F.explode(F.array(*[
            F.lit(s) for s in ("all", "therapist_spkr", "patient_spkr")])))
    )
    none = F.lit(None).cast("string")
    parts = [
        N.spread_over_codes(important, codes).withColumn("kind", F.lit("code")),
        important.withColumns({"kind": F.lit("important"), "code": none}),
        rest.withColumns({"kind": F.lit("rest"), "code": none}),
    ]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        everything.withColumn("rater", rater())
        .groupBy("kind", "slice", "rater", "source_file", "code").agg(F.count("*").alias("n_seqs"))
    )


def session_rates(hub: DataFrame, target: str) -> DataFrame:
    """Share of rows important to the target per session that has any."""
    flag = F.when(B.is_important(target), 1).otherwise(0)
    counts = hub.groupBy("source_file").agg(
        F.count("*").alias("n_das"), F.sum(flag).alias("n_important"))
    return counts.filter(F.col("n_important") > 0).select(
        rater().alias("rater"), "source_file", "n_das", "n_important",
        (F.col("n_important") / F.col("n_das")).alias("rate"))


def rate_summary(rates: DataFrame) -> DataFrame:
    """Spread of the (four-digit) session rates per rater."""
    rate = F.round("rate", 4)
    return rates.groupBy("rater").agg(
        F.count("*").alias("n_sessions"), F.avg(rate).alias("mean_rate"),
        F.stddev_samp(rate).alias("std_rate"), F.min(rate).alias("min_rate"),
        F.max(rate).alias("max_rate"))


def rate_consistency(rates: DataFrame) -> DataFrame:
    """Two readings of alpha on session rates.

    `alpha_within` is the established column: mean squared pair difference over the sample
    variance, which is 2 for any spread, so it reads -1 unless rates are equal.
    `alpha_between` is interval alpha with sessions of one rater as the values of a unit:
    1 - within-rater variance / total variance.
    """
    stats = rates.groupBy("rater").agg(
        F.count("*").alias("n_sessions"), F.avg("rate").alias("mean_rate"),
        F.stddev_pop("rate").alias("std_rate"), F.var_samp("rate").alias("_variance"),
        F.sum("rate").alias("_sum"), F.sum(F.col("rate") * F.col("rate")).alias("_squares"))
    n, variance = F.col("n_sessions"), F.col("_variance")
    alpha = F.when(n >= 2, F.when(variance > 1e-10, 1.0 - 2.0 * variance / variance).otherwise(1.0))
    paired = stats.filter(n >= 2).withColumn("scope", F.lit(1)).groupBy("scope").agg(
        F.sum(2.0 * n * (F.col("_squares") - F.col("_sum") * F.col("_sum") / n) / (n - 1)).alias("_within"),
        F.sum(n).alias("_n"), F.sum("_sum").alias("_s"), F.sum("_squares").alias("_q"))
    total, m = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"), F.col("_n")
    between = paired.select("scope", F.when(
        total > 1e-12, 1.0 - (m - 1) * F.col("_within") / (2.0 * m * total)).alias("alpha_between"))
    return (
        stats.withColumns({"alpha_within": alpha, "scope": F.lit(1)})
        .join(F.broadcast(between), "scope", "left")
        .withColumn("note", F.when(n < 2, "need_>=2_sessions").when(F.col("alpha_within") > 0.8, "good")
                    .when(F.col("alpha_within") > 0.67, "tentative").otherwise("unreliable"))
        .drop("scope", "_variance", "_sum", "_squares")
    )


def pooled_over(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def compare(counts: DataFrame, keys: Sequence[str], group: str, feature: str = "ngram") -> DataFrame:
    """Chi-square with p-value and natural-log divergence for every pair of groups."""
    tests = P.count_tests(counts, keys, group, feature, "cnt")
    return tests.withColumns({
        "p_value": chi2_p_value("chi2", "dof"),
        "js": F.when(F.col("chi2").isNotNull(), F.col("js")),
        "js_any": F.col("js"),
    })


OTHER_SESSIONS = "(other sessions)"


def against_rest(counts: DataFrame, keys: Sequence[str], group: str, feature: str = "ngram") -> DataFrame:
    """Each group of a key against all other groups of that key pooled, one row per group.

    The others are the key's total minus the group's own counts, so the work grows with the
    number of groups, not with their pairs.
    """
    keys = list(keys)
    total = pooled_over(counts, *keys, feature).withColumnRenamed("cnt", "_total")
    groups = counts.select(*keys, group).distinct()
    sides = (
        total.join(groups, keys)
        .join(counts.select(*keys, group, feature, "cnt"), [*keys, group, feature], "left")
        .withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        .select(*keys, group, feature, F.inline(F.array(
            F.struct(F.lit(0).alias("_side"), F.col("cnt").alias("cnt")),
            F.struct(F.lit(1).alias("_side"), (F.col("_total") - F.col("cnt")).alias("cnt")),
        )))
        .filter(F.col("cnt") > 0)
    )
    return compare(sides, [*keys, group], "_side", feature).withColumns(
        {"a": F.col(group), "b": F.lit(OTHER_SESSIONS)}).drop(group)


def within_raters(labels: DataFrame) -> DataFrame:
    """Each session of a rater against the rater's other sessions, per code: one row per
    session whatever the number of sessions. A rater's only session has nothing to meet."""
    return against_rest(labels, ["slice", "code", "rater"], "source_file")


OTHER_RATERS = "(other raters)"


def raters_against_others(counts: DataFrame) -> DataFrame:
    """Label counts of each rater of a code against all its other raters pooled: one row per
    rater where the table of pairs has one per two raters."""
    labels = pooled_over(
        counts.filter((F.col("kind") == "code") & (F.col("n") == 1)), "slice", "code", "rater", "ngram")
    tests = P.tests_against_rest(labels, ["slice", "code"], "rater", "ngram", "cnt")
    return tests.withColumns({
        "p_value": chi2_p_value("chi2", "dof"),
        "js_any": F.col("js"),
        "js": F.when(F.col("chi2").isNotNull(), F.col("js")),
        "b": F.lit(OTHER_RATERS),
    }).withColumnRenamed("rater", "a")


def ceilings_against_others(counts: DataFrame, sequences: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """`rater_ceilings` of each rater against the other raters of a code pooled. Columns as for
    pairs; `b` is the pool and `n_seqs_b` the others' sequences."""
    keys = ["slice", "code"]
    coded = pooled_over(counts.filter(F.col("kind") == "code"), *keys, "rater", "n", "ngram")
    wanted = sorted({1, *sizes})
    wide = (
        P.tests_against_rest(coded.filter(F.col("n").isin(*wanted)), [*keys, "n"], "rater", "ngram", "cnt")
        .groupBy(*keys, "rater").pivot("n", wanted).agg(F.first("js"))
        .withColumnsRenamed({str(n): f"js_{n}gram" for n in wanted})
        .withColumn("js_freq", F.col("js_1gram"))
    )
    both = coded.filter(F.col("n").isin(*sizes)).withColumn("_feature", F.concat_ws(":", "n", "ngram"))
    combined = P.tests_against_rest(both, keys, "rater", "_feature", "cnt").select(
        *keys, "rater", F.col("js").alias("js_combined_ngram"))
    own = sequences.filter(F.col("kind") == "code").groupBy(*keys, "rater").agg(F.sum("n_seqs").alias("n_seqs_a"))
    whole = own.groupBy(*keys).agg(F.sum("n_seqs_a").alias("_all"))
    return _with_ceilings(
        wide.join(combined, [*keys, "rater"], "left").join(own, [*keys, "rater"]).join(whole, keys)
        .withColumns({"n_seqs_b": F.col("_all") - F.col("n_seqs_a"), "b": F.lit(OTHER_RATERS)})
        .withColumnRenamed("rater", "a").drop("_all"))


def kappa_of(js: Column) -> Column:
    """Agreement read off a divergence: 1 where equal, never below 0."""
    return F.greatest(F.lit(0.0), 1.0 - js)


def f1_ceiling(kappa: Column) -> Column:
    return (1.0 + F.greatest(F.lit(0.0), kappa)) / 2.0


def verdict(js: Column, agree: float = 0.3, disagree: float = 0.5) -> Column:
    return F.when(js < agree, "AGREE").when(js > disagree, "DISAGREE").otherwise("MIXED")


def noise_band(kappa: Column) -> Column:
    return (
        F.when(kappa > 0.8, "CONSISTENT").when(kappa > 0.6, "MODERATE")
        .when(kappa > 0.4, "NOISY").otherwise("HIGH NOISE")
    )


def divergences(counts: DataFrame, keys: Sequence[str], group: str,
                sizes: Sequence[int]) -> DataFrame:
    """Divergence of label counts, of each n-gram size, and of all sizes in one vector."""
    keys = list(keys)
    wanted = sorted({1, *sizes})
    per_size = P.count_divergence(
        counts.filter(F.col("n").isin(*wanted)), [*keys, "n"], group, "ngram", "cnt")
    wide = (
        per_size.groupBy(*keys, "a", "b").pivot("n", wanted).agg(F.first("js"))
        .withColumnsRenamed({str(n): f"js_{n}gram" for n in wanted})
        .withColumn("js_freq", F.col("js_1gram"))
    )
    both = counts.filter(F.col("n").isin(*sizes)).withColumn("_feature", F.concat_ws(":", "n", "ngram"))
    combined = P.count_divergence(both.drop("n"), keys, group, "_feature", "cnt")
    return wide.join(
        combined.withColumnRenamed("js", "js_combined_ngram"), [*keys, "a", "b"], "left")


def rater_ceilings(counts: DataFrame, sequences: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """What divergence between raters of one code leaves a classifier, per pair of raters."""
    coded = pooled_over(counts.filter(F.col("kind") == "code"), "slice", "code", "rater", "n", "ngram")
    sizes_of = sequences.filter(F.col("kind") == "code").groupBy("slice", "code", "rater").agg(
        F.sum("n_seqs").alias("n_seqs"))
    keys = ["slice", "code"]
    pairs = divergences(coded, keys, "rater", sizes)
    for side in ("a", "b"):
        pairs = pairs.join(
            sizes_of.select(*keys, F.col("rater").alias(side), F.col("n_seqs").alias(f"n_seqs_{side}")),
            [*keys, side])
    return _with_ceilings(pairs)


def _with_ceilings(rows: DataFrame) -> DataFrame:
    kappa, kappa_ngram = kappa_of(F.col("js_freq")), kappa_of(F.col("js_combined_ngram"))
    return rows.withColumns({
        "kappa_analogue": kappa, "f1_ceiling": f1_ceiling(kappa),
        "kappa_combined_ngram": F.when(F.col("js_combined_ngram").isNotNull(), kappa_ngram),
        "f1_ceiling_ngram": F.when(F.col("js_combined_ngram").isNotNull(), f1_ceiling(kappa_ngram)),
    })


def ceiling_summary(ceilings: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Means and extremes of the (four-digit) ceilings and n-gram divergences, per slice and
    code and per slice."""
    value = {c: F.round(c, 4) for c in ("js_freq", "kappa_analogue", "f1_ceiling")}
    ngram = {n: F.round(f"js_{n}gram", 4) for n in sizes}
    rows = ceilings.withColumn("code", F.explode(F.array(F.col("code"), F.lit(POOLED))))
    return rows.groupBy("slice", "code").agg(
        F.avg(value["js_freq"]).alias("mean_js"), F.avg(value["kappa_analogue"]).alias("mean_kappa"),
        F.avg(value["f1_ceiling"]).alias("mean_f1"), F.min(value["f1_ceiling"]).alias("min_f1"),
        F.max(value["f1_ceiling"]).alias("max_f1"),
        *[how(js).alias(f"{name}_js_{n}gram") for n, js in ngram.items()
          for name, how in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    ).withColumn("band", noise_band(F.col("mean_kappa")))


def _by_rater_and_pooled(df: DataFrame) -> DataFrame:
    return df.withColumn("rater", F.explode(F.array(F.col("rater"), F.lit(POOLED))))


def important_against_rest(counts: DataFrame, sequences: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """How separable important blocks are from the rest, per rater and pooled. Here a high
    divergence is good, so it is used as kappa directly."""
    keys = ["slice", "rater"]
    both = F.col("kind").isin("important", "rest")
    sides = pooled_over(_by_rater_and_pooled(counts.filter(both)), *keys, "kind", "n", "ngram")
    n_seqs = _by_rater_and_pooled(sequences.filter(both)).groupBy(*keys).pivot(
        "kind", ["important", "rest"]).agg(F.sum("n_seqs"))
    return (
        divergences(sides, keys, "kind", sizes)
        .join(n_seqs.withColumnsRenamed({"important": "n_important", "rest": "n_rest"}), keys)
        .withColumns({
            "kappa": F.col("js_freq"), "f1_ceiling": f1_ceiling(F.col("js_freq")),
            "f1_ceiling_ngram": f1_ceiling(F.col("js_combined_ngram")),
        })
        .drop("a", "b")
    )


def code_discrimination(counts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Divergence between codes, per rater and pooled. `kappa` follows 1 - divergence;
    `separability` is the divergence itself."""
    keys = ["slice", "rater"]
    coded = F.col("kind") == "code"
    labels = pooled_over(
        _by_rater_and_pooled(counts.filter(coded & (F.col("n") == 1))), *keys, "code", "ngram")
    n_seqs = _by_rater_and_pooled(sequences.filter(coded)).groupBy(*keys, "code").agg(
        F.sum("n_seqs").alias("n"))
    pairs = P.count_divergence(labels, keys, "code", "ngram", "cnt")
    for side in ("a", "b"):
        pairs = pairs.join(n_seqs.select(*keys, F.col("code").alias(side), F.col("n").alias(f"n_{side}")),
                           [*keys, side])
    kappa = kappa_of(F.col("js"))
    return pairs.withColumns({
        "kappa": kappa, "f1_ceiling": f1_ceiling(kappa), "separability": F.col("js")})


def discrimination_summary(pairs: DataFrame) -> DataFrame:
    kappa = kappa_of(F.col("mean_js"))
    return pairs.groupBy("slice", "rater").agg(
        F.avg("js").alias("mean_js"), F.count("*").alias("n_pairs")
    ).withColumns({"kappa": kappa, "f1_ceiling": f1_ceiling(kappa)})


def code_against_others(counts: DataFrame, sequences: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Each code, pooled over raters, against all other codes and the rest. The others are
    the total minus the code's own counts, so nothing is counted twice."""
    counted = counts.filter(F.col("kind").isin("code", "rest"))
    total = pooled_over(counted, "slice", "n", "ngram").withColumnRenamed("cnt", "total")
    own = pooled_over(counted.filter(F.col("kind") == "code"), "slice", "code", "n", "ngram")
    code_list = own.select("slice", "code").distinct()
    sides = (
        total.join(code_list, "slice")
        .join(own, ["slice", "code", "n", "ngram"], "left")
        .withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        .select("slice", "code", "n", "ngram", F.inline(F.array(
            F.struct(F.lit("code").alias("side"), F.col("cnt").alias("cnt")),
            F.struct(F.lit("others").alias("side"), (F.col("total") - F.col("cnt")).alias("cnt")),
        )))
        .filter(F.col("cnt") > 0)
    )
    keys = ["slice", "code"]
    kinds = F.col("kind").isin("code", "rest")
    all_seqs = sequences.filter(kinds).groupBy("slice").agg(F.sum("n_seqs").alias("_all"))
    n_pos = sequences.filter(F.col("kind") == "code").groupBy(*keys).agg(F.sum("n_seqs").alias("n_pos"))
    return (
        divergences(sides, keys, "side", sizes)
        .join(n_pos, keys).join(all_seqs, "slice")
        .withColumns({
            "n_neg": F.col("_all") - F.col("n_pos"), "kappa_freq": F.col("js_freq"),
            "f1_ceiling_freq": f1_ceiling(F.col("js_freq")),
            "f1_ceiling_ngram": f1_ceiling(F.col("js_combined_ngram")),
        })
        .drop("a", "b", "_all")
    )


def ranked_similarity(counts: DataFrame) -> DataFrame:
    """Every (rater, code) against every (other rater, code), most similar first."""
    labels = pooled_over(
        counts.filter((F.col("kind") == "code") & (F.col("n") == 1)), "slice", "rater", "code", "ngram")
    both = labels.withColumn("who", F.struct("rater", "code"))
    sizes = labels.groupBy("slice", F.struct("rater", "code").alias("who")).agg(F.sum("cnt").alias("n"))
    pairs = P.count_divergence(both, ["slice"], "who", "ngram", "cnt").filter(
        F.col("a.rater") != F.col("b.rater"))
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select("slice", F.col("who").alias(side), F.col("n").alias(f"n_{side}")),
                           ["slice", side])
    return pairs.select("slice", "js", F.inline(F.array(
        F.struct(F.col("a.rater").alias("t_a"), F.col("a.code").alias("code_a"), F.col("b.rater").alias("t_b"),
                 F.col("b.code").alias("code_b"), F.col("n_a").alias("n_a"), F.col("n_b").alias("n_b")),
        F.struct(F.col("b.rater").alias("t_a"), F.col("b.code").alias("code_a"), F.col("a.rater").alias("t_b"),
                 F.col("a.code").alias("code_b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")),
    ))).withColumn("same_code", F.col("code_a") == F.col("code_b"))


def nearest_similar(counts: DataFrame, k: int = 5) -> DataFrame:
    """The first k rows of `ranked_similarity` for each (rater, code), found without the others."""
    labels = pooled_over(
        counts.filter((F.col("kind") == "code") & (F.col("n") == 1)), "slice", "rater", "code", "ngram")
    found = NN.nearest(labels, ["slice"], "rater", "code", "ngram", "cnt", k)
    return found.select(
        "slice", F.col("rater").alias("t_a"), F.col("code").alias("code_a"), "rank",
        F.col("other_owner").alias("t_b"), F.col("other_item").alias("code_b"),
        F.col("size").alias("n_a"), F.col("other_size").alias("n_b"), "js",
        (F.col("code") == F.col("other_item")).alias("same_code"))
