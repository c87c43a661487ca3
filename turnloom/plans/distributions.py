"""Queries over label distributions and contingency tables (inventory F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import blocks as B
from turnloom.operators import distributions as D
from turnloom.plans import oracle
from turnloom.plans.registry import registered
from turnloom.plans.tables import tables

GROUPS = D.GROUP_ORDER


def r6(column):
    return F.round(column, 6)


oracle.add_view("splits", f"""
    SELECT h.*, 'speaker' AS comparison, lower(speaker) AS split FROM hub h
    UNION ALL SELECT h.*, 'importance', 'patient' FROM hub h WHERE patient
    UNION ALL SELECT h.*, 'importance', 'therapist' FROM hub h WHERE therapist
    UNION ALL SELECT h.*, 'importance', 'nonimp' FROM hub h WHERE NOT (patient OR therapist)
    UNION ALL SELECT h.*, 'any_importance', CASE WHEN patient OR therapist THEN 'important' ELSE 'nonimportant' END FROM hub h
    UNION ALL SELECT h.*, 'patient_importance', CASE WHEN patient THEN 'important' ELSE 'nonimportant' END FROM hub h
    UNION ALL SELECT h.*, 'therapist_importance', CASE WHEN therapist THEN 'important' ELSE 'nonimportant' END FROM hub h
    UNION ALL SELECT h.*, 'cross_importance', 't_' || lower(left(speaker, 1)) || '_important' FROM hub h WHERE therapist
    UNION ALL SELECT h.*, 'cross_importance', 'p_' || lower(left(speaker, 1)) || '_important' FROM hub h WHERE patient
    UNION ALL SELECT h.*, 'cross_importance', 'non_important' FROM hub h WHERE NOT (patient OR therapist)
    UNION ALL SELECT h.*, lower(speaker) || '_speaking',
              CASE WHEN patient OR therapist THEN 'important' ELSE 'nonimportant' END FROM hub h
    UNION ALL SELECT h.*, 'transcript', source_file FROM hub h
    UNION ALL SELECT h.*, 'therapist', 'therapist_' || marker_id FROM hub h
    UNION ALL SELECT h.*, lower(speaker) || '_speech', 'therapist_' || marker_id FROM hub h
    UNION ALL SELECT h.*, 'patient_code', unnest({oracle.codes('patient_code', "['noncoded']")}) FROM hub h
    UNION ALL SELECT h.*, 'therapist_code', unnest({oracle.codes('therapist_code', "['noncoded']")}) FROM hub h""")
oracle.add_view("split_counts", """
    SELECT comparison, split, proc_da AS label, count(*) AS cnt FROM splits GROUP BY ALL""")

# Which comparisons each inventory entry covers.
_COMPARISONS = {
    "f02_speaker": ["speaker"],
    "f03_importance": ["importance", "any_importance", "patient_importance", "therapist_importance"],
    "f04_cross_importance": ["cross_importance"],
    "f05_speaking": ["therapist_speaking", "patient_speaking"],
    "f06_code": ["patient_code", "therapist_code"],
    "f07_transcript": ["transcript"],
    "f08_therapist": ["therapist", "therapist_speech", "patient_speech"],
}


def _distribution(comparisons: list[str]):
    def query(spark, sf_dir):
        """Counts, shares and pooled rank per split (F1) for one family of comparisons."""
        rows = D.splits(tables(spark, sf_dir).hub(), comparisons)
        return D.distribution(rows).select(
            "comparison", "split", "label", "cnt", "total", r6("share").alias("share"), "pooled_rank")

    return query


for _name, _wanted in _COMPARISONS.items():
    _list = ", ".join(f"'{c}'" for c in _wanted)
    registered(f"{_name}_distribution", f"""
        SELECT comparison, split, label, cnt,
               CAST(sum(cnt) OVER (PARTITION BY comparison, split) AS BIGINT) AS total,
               round(cnt / sum(cnt) OVER (PARTITION BY comparison, split), 6) AS share, pooled_rank
        FROM split_counts JOIN (
          SELECT comparison, label, row_number() OVER (PARTITION BY comparison ORDER BY sum(cnt) DESC, label) AS pooled_rank
          FROM split_counts GROUP BY comparison, label) USING (comparison, label)
        WHERE comparison IN ({_list})""")(_distribution(_wanted))


@registered("f09_group_breakdown", f"""
    WITH g AS (SELECT *, {oracle.core('label')} AS core_group FROM split_counts)
    SELECT comparison, split, core_group, label, cnt,
           round(cnt / sum(cnt) OVER (PARTITION BY comparison, split, core_group), 6) AS label_share,
           round(sum(cnt) OVER (PARTITION BY comparison, split, core_group)
                 / sum(cnt) OVER (PARTITION BY comparison, split), 6) AS group_share
    FROM g WHERE core_group IS NOT NULL""")
def group_breakdown(spark, sf_dir):
    return D.group_breakdown(D.splits(tables(spark, sf_dir).hub())).select(
        "comparison", "split", "core_group", "label", "cnt",
        r6("label_share").alias("label_share"), r6("group_share").alias("group_share"))


@registered("f10_question_counts", f"""
    SELECT speaker, count(*) AS n_questions, count(*) FILTER (WHERE patient OR therapist) AS n_important,
           count(*) FILTER (WHERE NOT (patient OR therapist)) AS n_not_important
    FROM hub WHERE {oracle.core('proc_da')} IN ('canonical_questions', 'non_canonical_questions') GROUP BY ALL""")
def question_counts(spark, sf_dir):
    return D.question_counts(tables(spark, sf_dir).hub())


_INDICATORS = ", ".join(
    f"CAST(coalesce({oracle.core('proc_da')} = '{g}', false) AS INT) AS {g}" for g in L.CORE_GROUPS)


@registered("f11_group_indicators", f"SELECT source_file, pos, {_INDICATORS} FROM hub")
def group_indicators(spark, sf_dir):
    return D.group_indicators(tables(spark, sf_dir).hub())


oracle.add_view("window_code_rows", f"""
    SELECT 'patient' AS target, source_file, block_start, code FROM patient_codes
    UNION ALL
    SELECT DISTINCT 'therapist', b.source_file, b.block_start, coalesce(c.code, 'NA') FROM therapist_blocks b LEFT JOIN (
      SELECT source_file, therapist_start AS block_start, unnest({oracle.codes('therapist_code')}) AS code
      FROM hub WHERE therapist_start IS NOT NULL AND therapist_code IS NOT NULL) c USING (source_file, block_start)""")
oracle.add_view("profile_rows", f"""
    SELECT c.target, r.region, c.code, {oracle.core('r.proc_da', "'other'")} AS core_group, count(*) AS cnt
    FROM (SELECT 'patient' AS target, * FROM ({oracle.context('patient', 15)})
          UNION ALL SELECT 'therapist', * FROM ({oracle.context('therapist', 15)})) r
    JOIN window_code_rows c ON c.target = r.target AND c.source_file = r.source_file AND c.block_start = r.block_start
    GROUP BY ALL""")
_WIDE = ", ".join(f"coalesce(sum(cnt) FILTER (WHERE core_group = '{g}'), 0) AS {g}" for g in GROUPS)
oracle.add_view("profile_wide", f"""
    SELECT t.target, t.region, t.code, max(t.n_turns) AS n_turns, {_WIDE} FROM (
      SELECT target, region, code, count(*) AS n_turns
      FROM window_code_rows, (VALUES ('pre'), ('core'), ('post')) v(region) GROUP BY ALL) t
    LEFT JOIN profile_rows p ON p.target = t.target AND p.region = t.region AND p.code = t.code GROUP BY ALL""")
_TOTAL = "greatest(" + " + ".join(GROUPS) + ", 1)"
oracle.add_view("profile_shares", f"""
    SELECT target, region, code, n_turns, {", ".join(f"{g} / {_TOTAL} AS {g}" for g in GROUPS)} FROM profile_wide""")


def code_profiles(spark, sf_dir):
    """Wide (target, region, code) profile over both targets, written once: it is small and
    several tests read it."""
    t = tables(spark, sf_dir)

    def build():
        parts = []
        for target in B.TARGETS:
            codes = B.block_codes(t.hub(), target, skip_null=True)
            regions = B.context_rows(t.hub(), t.order, target)
            parts.append(D.profile_table(D.code_profile(regions, codes), codes)
                         .withColumn("target", F.lit(target)))
        return parts[0].unionByName(parts[1])

    return t.once("code_profiles", build)


_KEYS = ["target", "region", "code", "n_turns"]


@registered("f12_code_profile", f"""
    SELECT target, region, code, n_turns, {", ".join(f"CAST({g} AS BIGINT) AS {g}" for g in GROUPS)} FROM profile_wide""")
def code_profile(spark, sf_dir):
    return code_profiles(spark, sf_dir).select(*_KEYS, *GROUPS)


@registered("f13_code_proportions", f"""
    SELECT target, region, code, n_turns, n_turns < 2 AS low_support,
           {", ".join(f"round({g}, 6) AS {g}" for g in GROUPS)} FROM profile_shares""")
def code_proportions(spark, sf_dir):
    return D.proportions(code_profiles(spark, sf_dir)).select(
        *_KEYS, (F.col("n_turns") < 2).alias("low_support"), *[r6(g).alias(g) for g in GROUPS])


@registered("f14_region_comparison", f"""
    SELECT target, code, core_group, round(max(share) FILTER (WHERE region = 'pre'), 6) AS pre,
           round(max(share) FILTER (WHERE region = 'core'), 6) AS core,
           round(max(share) FILTER (WHERE region = 'post'), 6) AS post
    FROM (UNPIVOT profile_shares ON {", ".join(GROUPS)} INTO NAME core_group VALUE share) GROUP BY ALL""")
def region_comparison(spark, sf_dir):
    """Proportions before, in and after the blocks of each code, side by side."""
    shares = D.proportions(code_profiles(spark, sf_dir))
    long = shares.unpivot(["target", "region", "code"], GROUPS, "core_group", "share")
    return (
        long.groupBy("target", "code", "core_group").pivot("region", ["pre", "core", "post"])
        .agg(F.max("share")).fillna(0.0)
        .select("target", "code", "core_group", *[r6(c).alias(c) for c in ("pre", "core", "post")])
    )


_Z = ", ".join(
    f"round(({g} - avg({g}) OVER w) / CASE WHEN stddev_pop({g}) OVER w < 1e-12 THEN 1 ELSE stddev_pop({g}) OVER w END, 6)"
    f" + 0.0 AS {g}" for g in GROUPS)


@registered("f15_profile_z_scores", f"""
    SELECT target, region, code, n_turns, {_Z} FROM profile_shares WINDOW w AS (PARTITION BY target, region)""")
def profile_z_scores(spark, sf_dir):
    shares = D.proportions(code_profiles(spark, sf_dir))
    return D.z_scores(shares, ["target", "region"]).select(
        *_KEYS, *[(r6(g) + 0.0).alias(g) for g in GROUPS])


@registered("f16_code_group_shares", f"""
    SELECT target, code, core_group, cnt, round(cnt / sum(cnt) OVER (PARTITION BY target, code), 6) AS share,
           CAST(sum(cnt) OVER (PARTITION BY target, code) AS BIGINT) AS total
    FROM (SELECT target, code, {oracle.core('proc_da', "'unmapped'")} AS core_group, count(*) AS cnt FROM (
        SELECT 'patient' AS target, proc_da, unnest({oracle.codes('patient_code')}) AS code FROM hub
        UNION ALL SELECT 'therapist', proc_da, unnest({oracle.codes('therapist_code')}) FROM hub) GROUP BY ALL)""")
def code_group_shares(spark, sf_dir):
    """Core-group shares per code over all rows, codes ordered by total."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), L.parse_codes(F.col(f"{t}_code")).alias("codes"))
        for t in B.TARGETS
    ])
    counts = (
        tables(spark, sf_dir).hub()
        .select("proc_da", F.inline(cells))
        .select("proc_da", "target", F.explode("codes").alias("code"))
        .groupBy("target", "code", L.core_group(F.col("proc_da"), "unmapped").alias("core_group"))
        .agg(F.count("*").alias("cnt"))
    )
    totals = counts.groupBy("target", "code").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, ["target", "code"]).select(
        "target", "code", "core_group", "cnt", r6(F.col("cnt") / F.col("total")).alias("share"),
        "total",
    ).orderBy("target", F.col("total").desc(), "code", "core_group")


@registered("f17_code_usage", """
    SELECT rater, code, n_blocks, round(n_blocks / sum(n_blocks) OVER (PARTITION BY rater), 6) AS share FROM (
      SELECT rater, code, count(*) AS n_blocks FROM patient_codes
      JOIN (SELECT DISTINCT source_file, rater FROM hub) USING (source_file) GROUP BY ALL)""")
def code_usage(spark, sf_dir):
    """Blocks per therapist and code, and the share of a therapist's blocks."""
    counts = (
        tables(spark, sf_dir).block_codes("patient")
        .groupBy(L.therapist_in_prefix(F.col("source_file")).alias("rater"), "code")
        .agg(F.count("*").alias("n_blocks"))
    )
    totals = counts.groupBy("rater").agg(F.sum("n_blocks").alias("_all"))
    return counts.join(totals, "rater").select(
        "rater", "code", "n_blocks", r6(F.col("n_blocks") / F.col("_all")).alias("share"))


CODE_COLUMNS = [*L.CODE_DESCRIPTIONS, "NA"]


@registered("f17_code_usage_matrix", """
    SELECT rater, """ + ", ".join(f"count(*) FILTER (WHERE code = '{c}') AS {c}" for c in CODE_COLUMNS)
    + f""", count(*) FILTER (WHERE code NOT IN ({', '.join(f"'{c}'" for c in CODE_COLUMNS)})) AS other"""
    + """ FROM patient_codes JOIN (SELECT DISTINCT source_file, rater FROM hub) USING (source_file) GROUP BY ALL""")
def code_usage_matrix(spark, sf_dir):
    """The same counts as a matrix: a wide sink over the fixed code list (A13), codes outside
    the list under `other`."""
    code = F.when(F.col("code").isin(CODE_COLUMNS), F.col("code")).otherwise("other")
    return (
        tables(spark, sf_dir).block_codes("patient")
        .groupBy(L.therapist_in_prefix(F.col("source_file")).alias("rater"), code.alias("code"))
        .agg(F.count("*").alias("cnt")).groupBy("rater")
        .pivot("code", [*CODE_COLUMNS, "other"]).agg(F.first("cnt")).fillna(0)
    )


@registered("f19_blocks_per_code", """
    SELECT 'patient' AS target, code, count(*) AS n_blocks FROM patient_codes GROUP BY ALL
    UNION ALL SELECT 'therapist', code, count(*) FROM therapist_codes GROUP BY ALL""")
def blocks_per_code(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = [
        t.block_codes(target).groupBy(F.lit(target).alias("target"), "code")
        .agg(F.count("*").alias("n_blocks"))
        for target in B.TARGETS
    ]
    return parts[0].unionByName(parts[1])
