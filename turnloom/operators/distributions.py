"""Label distributions of row groups, and contingency tables per code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators.blocks import is_important

GROUP_ORDER = list(L.CORE_GROUPS) + [L.OTHER]


def _entry(comparison: str, split: Column) -> Column:
    return F.struct(F.lit(comparison).alias("comparison"), split.alias("split"))


def _named(comparison: str, splits: dict[str, Column]) -> list[Column]:
    return [F.when(cond, _entry(comparison, F.lit(name))) for name, cond in splits.items()]


def _code_entries(target: str) -> Column:
    found = L.parse_codes(F.col(f"{target}_code"), default="noncoded")
    return F.transform(found, lambda code: _entry(f"{target}_code", code))


def splits(hub: DataFrame, comparisons: Sequence[str] | None = None) -> DataFrame:
    """One row per (row, comparison, split) of the wanted comparisons (default: all). Splits of
    a comparison may overlap: a row that is important to both sides counts in both."""
    patient, therapist = is_important("patient"), is_important("therapist")
    either = patient | therapist
    by_therapist = F.col("speaker") == "Therapist"
    by_patient = F.col("speaker") == "Patient"
    therapist_id = F.concat(F.lit("therapist_"), L.therapist_before_marker(F.col("source_file")))
    named = {
        "speaker": {
            "therapist": by_therapist, "patient": by_patient, "other": ~(by_therapist | by_patient)},
        "importance": {"patient": patient, "therapist": therapist, "nonimp": ~either},
        "any_importance": {"important": either, "nonimportant": ~either},
        "patient_importance": {"important": patient, "nonimportant": ~patient},
        "therapist_importance": {"important": therapist, "nonimportant": ~therapist},
        "cross_importance": {
            "t_t_important": therapist & by_therapist, "t_p_important": therapist & by_patient,
            "p_t_important": patient & by_therapist, "p_p_important": patient & by_patient,
            "non_important": ~either},
        "therapist_speaking": {
            "important": by_therapist & either, "nonimportant": by_therapist & ~either},
        "patient_speaking": {
            "important": by_patient & either, "nonimportant": by_patient & ~either},
    }
    entries = {
        **{name: F.array_compact(F.array(*_named(name, parts))) for name, parts in named.items()},
        "transcript": F.array(_entry("transcript", F.col("source_file"))),
        "therapist": F.array(_entry("therapist", therapist_id)),
        "therapist_speech": F.array_compact(F.array(
            F.when(by_therapist, _entry("therapist_speech", therapist_id)))),
        "patient_speech": F.array_compact(F.array(
            F.when(by_patient, _entry("patient_speech", therapist_id)))),
        "patient_code": _code_entries("patient"),
        "therapist_code": _code_entries("therapist"),
    }
    wanted = [entries[name] for name in (comparisons or entries)]
    return hub.select("*", F.inline(F.concat(*wanted)))


def distribution(rows: DataFrame, label: str = "proc_da") -> DataFrame:
    """Count and share of each label per split, with the label's rank by pooled count."""
    counts = rows.groupBy("comparison", "split", F.col(label).alias("label")).agg(
        F.count("*").alias("cnt"))
    totals = counts.groupBy("comparison", "split").agg(F.sum("cnt").alias("total"))
    pooled = counts.groupBy("comparison", "label").agg(F.sum("cnt").alias("_pooled"))
    w = Window.partitionBy("comparison").orderBy(F.col("_pooled").desc(), "label")
    ranks = pooled.select("comparison", "label", F.row_number().over(w).alias("pooled_rank"))
    return (
        counts.join(totals, ["comparison", "split"])
        .join(ranks, ["comparison", "label"])
        .withColumn("share", F.col("cnt") / F.col("total"))
    )


def group_breakdown(rows: DataFrame, label: str = "proc_da") -> DataFrame:
    """Per core group, the share of each member label in a split, and the share of the group
    among all grouped rows of the split."""
    counts = (
        rows.withColumn("core_group", L.core_group(F.col(label)))
        .filter(F.col("core_group").isNotNull())
        .groupBy("comparison", "split", "core_group", F.col(label).alias("label"))
        .agg(F.count("*").alias("cnt"))
    )
    per_group = counts.groupBy("comparison", "split", "core_group").agg(
        F.sum("cnt").alias("group_cnt"))
    per_split = per_group.groupBy("comparison", "split").agg(F.sum("group_cnt").alias("_all"))
    shares = per_group.join(per_split, ["comparison", "split"]).select(
        "comparison", "split", "core_group", "group_cnt",
        (F.col("group_cnt") / F.col("_all")).alias("group_share"))
    return counts.join(shares, ["comparison", "split", "core_group"]).withColumn(
        "label_share", F.col("cnt") / F.col("group_cnt"))


def group_indicators(hub: DataFrame) -> DataFrame:
    """One 0/1 column per core group along each transcript."""
    group = L.core_group(F.col("proc_da"), L.OTHER)
    return hub.select(
        "source_file", "pos",
        *[F.when(group == name, 1).otherwise(0).alias(name) for name in L.CORE_GROUPS],
    )


def question_counts(hub: DataFrame) -> DataFrame:
    """Questions asked per speaker, split by importance to either side."""
    either = is_important("patient") | is_important("therapist")
    return (
        hub.filter(L.core_group(F.col("proc_da")).isin(*L.QUESTION_GROUPS))
        .groupBy("speaker")
        .agg(F.count("*").alias("n_questions"), F.count_if(either).alias("n_important"),
             F.count_if(~either).alias("n_not_important"))
    )


def code_profile(regions: DataFrame, codes: DataFrame) -> DataFrame:
    """Core-group counts per (region, code) from the rows of block regions, long form.

    Rows are counted per block before they meet the block's codes.
    """
    per_block = regions.groupBy(
        "source_file", "block_start", "region",
        L.core_group(F.col("proc_da"), L.OTHER).alias("core_group"),
    ).agg(F.count("*").alias("cnt"))
    return (
        per_block.join(codes, ["source_file", "block_start"])
        .groupBy("region", "code", "core_group").agg(F.sum("cnt").alias("cnt"))
    )


def profile_table(profile: DataFrame, codes: DataFrame,
                  regions: Sequence[str] = ("pre", "core", "post")) -> DataFrame:
    """Wide profile: one row per (region, code), one column per group, with `n_turns`."""
    turns = codes.groupBy("code").agg(F.count("*").alias("n_turns")).withColumn(
        "region", F.explode(F.array(*[F.lit(r) for r in regions])))
    wide = profile.groupBy("region", "code").pivot("core_group", GROUP_ORDER).agg(F.sum("cnt"))
    return turns.join(wide, ["region", "code"], "left").fillna(0, GROUP_ORDER)


def proportions(table: DataFrame, groups: Sequence[str] = GROUP_ORDER) -> DataFrame:
    """Row proportions of a wide table; an all-zero row stays zero."""
    total = sum((F.col(g) for g in groups), F.lit(0))
    safe = F.when(total == 0, 1).otherwise(total)
    return table.withColumns({g: F.col(g) / safe for g in groups})


def z_scores(shares: DataFrame, by: Sequence[str], groups: Sequence[str] = GROUP_ORDER) -> DataFrame:
    """z-score of each group's proportion across the rows sharing `by`; no spread gives 0."""
    stats = shares.groupBy(*by).agg(
        *[F.avg(g).alias(f"_m_{g}") for g in groups],
        *[F.stddev_pop(g).alias(f"_s_{g}") for g in groups],
    )
    joined = shares.join(F.broadcast(stats), list(by))
    scored = {
        g: (F.col(g) - F.col(f"_m_{g}")) / F.when(F.col(f"_s_{g}") < 1e-12, 1.0).otherwise(F.col(f"_s_{g}"))
        for g in groups
    }
    return joined.withColumns(scored).drop(*[f"_{k}_{g}" for k in "ms" for g in groups])
