"""Queries over significance tests and question-response patterns (inventory G and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.stats import benjamini_hochberg, chi2_p_value
from turnloom.operators import blocks as B
from turnloom.operators import distributions as D
from turnloom.operators import ngrams as N
from turnloom.operators import pairs as P
from turnloom.operators import responses as R
from turnloom.operators import significance as S
from turnloom.plans import bags, oracle
from turnloom.plans.distributions import GROUPS, code_profiles
from turnloom.plans.registry import registered
from turnloom.plans.tables import SIZES, tables


def r6(column):
    return F.round(column, 6)


def _pattern_sql(counts: str, family: str, groups: str, min_total: int) -> str:
    """Full 2 x k tables from zero-filled counts; `groups` lists (family, grp)."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in family.split(", "))
    cell = "(abs({o} - {e}) - least({y}, abs({o} - {e}))) ** 2 / {e}"
    yates = "CASE WHEN k = 2 THEN 0.5 ELSE 0 END"
    first = cell.format(o="c", e="(tot * gn / allc)", y=yates)
    second = cell.format(o="(gn - c)", e="((allc - tot) * gn / allc)", y=yates)
    return f"""
      SELECT {family}, ngram, max(tot) AS total, sum({first} + {second}) AS chi2, max(k) - 1 AS dof FROM (
        SELECT z.*, sum(c) OVER (PARTITION BY {family}, ngram) AS tot, sum(c) OVER (PARTITION BY {family}, grp) AS gn,
               sum(c) OVER (PARTITION BY {family}) AS allc, count(*) OVER (PARTITION BY {family}, ngram) AS k
        FROM (SELECT {", ".join("x." + f for f in family.split(", "))}, x.ngram, y.grp, coalesce(c.cnt, 0) AS c
              FROM (SELECT DISTINCT {family}, ngram FROM {counts}) x JOIN {groups} y ON {on}
              LEFT JOIN {counts} c ON {" AND ".join(f"c.{f} = x.{f}" for f in family.split(", "))}
               AND c.ngram = x.ngram AND c.grp = y.grp) z)
      GROUP BY {family}, ngram HAVING min(gn) > 0 AND max(tot) >= {min_total} AND max(tot) < max(allc)"""


oracle.add_view("code_counts", "SELECT target, code AS grp, n, ngram, cnt FROM coded_grams")
oracle.add_view("code_groups", """
    SELECT DISTINCT target, code AS grp, n FROM target_codes, (VALUES (2), (3)) v(n)""")
oracle.add_view("code_chi2", f"""
    SELECT target, n, ngram, chi2, {oracle.chi2_tail('chi2', 'dof')} AS p_value
    FROM ({_pattern_sql('code_counts', 'target, n', 'code_groups', 1)}) SEMI JOIN top_coded USING (target, n, ngram)""")


@registered("g01_code_pattern_tests", f"""
    SELECT target, n, ngram, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, round(p_fdr, 6) AS p_fdr,
           p_fdr < 0.05 AS significant FROM ({oracle.corrected('code_chi2', 'target, n')})""")
def code_pattern_tests(spark, sf_dir):
    """Chi-square of each side's top patterns across codes, corrected per side and n."""
    counts = bags.coded(spark, sf_dir)
    sides = [tables(spark, sf_dir).block_codes(t).groupBy(F.lit(t).alias("target")).agg(
        F.countDistinct("code").alias("n_groups")) for t in B.TARGETS]
    n_groups = sides[0].unionByName(sides[1]).withColumn("n", F.explode(F.array(F.lit(2), F.lit(3))))
    family = ["target", "n"]
    top = F.broadcast(N.top_patterns(counts, 15, *family).select(*family, "ngram"))
    tests = S.pattern_chi_square(counts.withColumnRenamed("code", "group"), n_groups, family)
    return benjamini_hochberg(tests.join(top, [*family, "ngram"]), family).select(
        *family, "ngram", *[r6(c).alias(c) for c in ("chi2", "p_value", "p_fdr")], "significant")


oracle.add_view("level_counts", 'SELECT level, "group" AS grp, n, ngram, cnt FROM levels')
oracle.add_view("level_groups", """
    SELECT DISTINCT level, grp, n FROM (
      SELECT 'importance' AS level, unnest(['patient_important', 'therapist_important', 'non_important']) AS grp
      UNION ALL SELECT 'transcripts', source_file FROM hub
      UNION ALL SELECT 'therapists', 'therapist_' || marker_id FROM hub
      UNION ALL SELECT 'patient_codes', 'patient_' || code FROM patient_codes WHERE code <> 'NA'
      UNION ALL SELECT 'therapist_codes', 'therapist_' || code FROM therapist_codes WHERE code <> 'NA'
      UNION ALL SELECT unnest(['patient_codes', 'therapist_codes']), 'non_important'),
      (VALUES (2), (3), (4), (5)) v(n)""")
oracle.add_view("level_chi2", f"""
    SELECT level, n, ngram, total, chi2, {oracle.chi2_tail('chi2', 'dof')} AS p_value
    FROM ({_pattern_sql('level_counts', 'level, n', 'level_groups', 5)})""")


def level_groups(spark, sf_dir):
    """Number of groups per (level, n), counting groups without any n-gram."""
    t = tables(spark, sf_dir)
    hub = t.hub()
    counted = [
        hub.select(F.lit("transcripts").alias("level"), F.col("source_file").alias("group")),
        hub.select(F.lit("therapists").alias("level"),
                   bags.L.therapist_before_marker(F.col("source_file")).alias("group")),
        *[
            t.block_codes(target).filter(F.col("code") != "NA")
            .select(F.lit(f"{target}_codes").alias("level"), F.col("code").alias("group"))
            for target in ("patient", "therapist")
        ],
    ]
    sizes = [part.groupBy("level").agg(F.countDistinct("group").alias("n_groups")) for part in counted]
    everything = sizes[0]
    for part in sizes[1:]:
        everything = everything.unionByName(part)
    baseline = F.when(F.col("level").endswith("_codes"), 1).otherwise(0)
    importance = spark.range(1).select(F.lit("importance").alias("level"), F.lit(3).cast("long").alias("n_groups"))
    return (
        everything.withColumn("n_groups", F.col("n_groups") + baseline).unionByName(importance)
        .withColumn("n", F.explode(F.array(*[F.lit(n) for n in SIZES])))
    )


@registered("g02_group_ngram_tests", f"""
    SELECT level, n, ngram, CAST(total AS BIGINT) AS total, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value,
           round(p_fdr, 6) AS p_fdr, p_fdr < 0.05 AS significant FROM ({oracle.corrected('level_chi2', 'level')})""")
def group_ngram_tests(spark, sf_dir):
    """Chi-square of every n-gram seen five times or more across the groups of each level."""
    counts = tables(spark, sf_dir).ngram_counts()
    tests = S.pattern_chi_square(counts, level_groups(spark, sf_dir), ["level", "n"], 5)
    return benjamini_hochberg(tests, ["level"]).select(
        "level", "n", "ngram", "total",
        *[r6(c).alias(c) for c in ("chi2", "p_value", "p_fdr")], "significant")


oracle.add_view("importance_tests", oracle.corrected(
    "(SELECT * FROM level_chi2 WHERE level = 'importance')", "n"))


@registered("e10_difference_summary", """
    WITH v AS (SELECT DISTINCT n, ngram FROM levels WHERE level = 'importance'),
    f AS (SELECT v.n, v.ngram, g.grp, coalesce(l.freq, 0) AS freq, coalesce(l.cnt, 0) AS cnt
          FROM v CROSS JOIN (VALUES ('patient_important'), ('therapist_important'), ('non_important')) g(grp)
          LEFT JOIN level_freq l ON l.level = 'importance' AND l.n = v.n AND l.ngram = v.ngram AND l."group" = g.grp),
    p AS (SELECT n, ngram,
            max(freq) FILTER (WHERE grp = 'patient_important') AS p, max(freq) FILTER (WHERE grp = 'therapist_important') AS t,
            max(freq) FILTER (WHERE grp = 'non_important') AS o,
            max(cnt) FILTER (WHERE grp = 'patient_important') AS count_patient_important,
            max(cnt) FILTER (WHERE grp = 'therapist_important') AS count_therapist_important,
            max(cnt) FILTER (WHERE grp = 'non_important') AS count_non_important,
            max(freq) AS hi, min(freq) AS lo, stddev_pop(freq) AS sd FROM f GROUP BY ALL)
    SELECT p.n, p.ngram, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, round(p_fdr, 6) AS p_fdr,
           coalesce(p_fdr < 0.05, false) AS significant, round(p, 6) AS freq_patient_important, round(t, 6) AS freq_therapist_important,
           round(o, 6) AS freq_non_important, count_patient_important, count_therapist_important,
           count_non_important, round(p - t, 6) + 0.0 AS diff_patient_vs_therapist,
           round(p - o, 6) + 0.0 AS diff_patient_vs_non, round(t - o, 6) + 0.0 AS diff_therapist_vs_non,
           round(abs(p - t), 6) AS absdiff_patient_vs_therapist, round(abs(p - o), 6) AS absdiff_patient_vs_non,
           round(abs(t - o), 6) AS absdiff_therapist_vs_non, round(hi, 6) AS freq_max, round(lo, 6) AS freq_min,
           round(hi - lo, 6) AS freq_range, round(sd, 6) AS freq_std,
           CASE WHEN p = hi THEN 'patient_important' WHEN t = hi THEN 'therapist_important'
                ELSE 'non_important' END AS dominant_group
    FROM p LEFT JOIN importance_tests c ON c.n = p.n AND c.ngram = p.ngram""")
def difference_summary(spark, sf_dir):
    """Frequencies side by side with pairwise differences, dispersion and a test per n-gram,
    corrected per n."""
    counts = tables(spark, sf_dir).ngram_counts().filter(F.col("level") == "importance")
    groups = ["patient_important", "therapist_important", "non_important"]
    wide = (
        N.with_frequency(counts, "n", "group")
        .groupBy("n", "ngram").pivot("group", groups)
        .agg(F.max("freq").alias("freq"), F.max("cnt").alias("cnt")).fillna(0)
    )
    sizes = level_groups(spark, sf_dir).filter(F.col("level") == "importance").drop("level")
    tests = benjamini_hochberg(S.pattern_chi_square(counts.drop("level"), sizes, ["n"], 5), ["n"])
    joined = N.differences(wide, groups).join(
        tests.select("n", "ngram", "chi2", "p_value", "p_fdr", "significant"), ["n", "ngram"], "left")
    return joined.select(
        "n", "ngram", *[r6(c).alias(c) for c in ("chi2", "p_value", "p_fdr")],
        F.coalesce("significant", F.lit(False)).alias("significant"),
        *[r6(f"{g}_freq").alias(f"freq_{g}") for g in groups],
        *[F.col(f"{g}_cnt").alias(f"count_{g}") for g in groups],
        *[(r6(c) + 0.0).alias(c) for c in (
            "diff_patient_vs_therapist", "diff_patient_vs_non", "diff_therapist_vs_non",
            "absdiff_patient_vs_therapist", "absdiff_patient_vs_non", "absdiff_therapist_vs_non",
            "freq_max", "freq_min", "freq_range", "freq_std")],
        "dominant_group",
    )


def _pair_sql(counts: str, keys: str, group: str, feature: str) -> str:
    """Pairwise 2 x m chi-square from zero-filled tables, with Yates for 2 x 2, and JS terms."""
    on = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys.split(", "))
    ks = ", ".join(f"p.{k}" for k in keys.split(", "))
    cell = "(abs({o} - {e}) - least(CASE WHEN m = 2 THEN 0.5 ELSE 0 END, abs({o} - {e}))) ** 2 / {e}"
    row_a = cell.format(o="x", e="((x + y) * na / (na + nb))")
    row_b = cell.format(o="y", e="((x + y) * nb / (na + nb))")
    js = ("0.5 * ((x + 1e-10) / na) * ln(2 * ((x + 1e-10) / na) / ((x + 1e-10) / na + (y + 1e-10) / nb))"
          " + 0.5 * ((y + 1e-10) / nb) * ln(2 * ((y + 1e-10) / nb) / ((x + 1e-10) / na + (y + 1e-10) / nb))")
    return f"""
      SELECT {keys}, a, b, na AS n_a, nb AS n_b, CASE WHEN max(m) >= 2 THEN sum({row_a} + {row_b}) END AS chi2,
             CASE WHEN max(m) >= 2 THEN max(m) - 1 END AS dof, greatest(sum({js}), 0) AS js
      FROM (SELECT *, sum(x) OVER w AS na, sum(y) OVER w AS nb, count(*) OVER w AS m FROM (
              SELECT {ks}, p.a, p.b, f.feature, coalesce(max(l.cnt), 0) AS x, coalesce(max(r.cnt), 0) AS y
              FROM (SELECT {", ".join("s." + k for k in keys.split(", "))}, s.{group} AS a, t.{group} AS b
                    FROM (SELECT DISTINCT {keys}, {group} FROM {counts}) s
                    JOIN (SELECT DISTINCT {keys}, {group} FROM {counts}) t
                      ON {on.format("s", "t")} AND s.{group} < t.{group}) p
              JOIN (SELECT DISTINCT {keys}, {feature} AS feature FROM {counts}) f ON {on.format("p", "f")}
              LEFT JOIN {counts} l ON {on.format("l", "p")} AND l.{group} = p.a AND l.{feature} = f.feature
              LEFT JOIN {counts} r ON {on.format("r", "p")} AND r.{group} = p.b AND r.{feature} = f.feature
              GROUP BY ALL HAVING x + y > 0)
            WINDOW w AS (PARTITION BY {keys}, a, b))
      GROUP BY {keys}, a, b, na, nb"""


oracle.add_view("core_profile", "SELECT target, code, core_group, cnt FROM profile_rows WHERE region = 'core'")
oracle.add_view("profile_pairs", f"""
    SELECT target, a, b, chi2, {oracle.chi2_tail('chi2', 'dof')} AS p_value
    FROM ({_pair_sql('core_profile', 'target', 'code', 'core_group')})""")


def _profile_tests(spark, sf_dir):
    wide = code_profiles(spark, sf_dir).filter(F.col("region") == "core")
    counts = wide.unpivot(["target", "code"], GROUPS, "core_group", "cnt").filter(F.col("cnt") > 0)
    pairs = P.chi_square(counts, ["target"], "code", "core_group", "cnt").withColumn(
        "p_value", chi2_p_value("chi2", "dof"))
    return benjamini_hochberg(pairs, ["target"])


@registered("g03_code_pair_tests", f"""
    SELECT target, a, b, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, round(p_fdr, 6) AS p_fdr,
           coalesce(p_fdr < 0.05, false) AS significant FROM ({oracle.corrected('profile_pairs', 'target')})""")
def code_pair_tests(spark, sf_dir):
    """Pairwise chi-square between codes on core-group counts, corrected."""
    return _profile_tests(spark, sf_dir).select(
        "target", "a", "b", *[r6(c).alias(c) for c in ("chi2", "p_value", "p_fdr")], "significant")


@registered("g09_log_p_matrix", f"""
    SELECT target, unnest([a, b]) AS a, unnest([b, a]) AS b, round(-log10(greatest(p_fdr, 1e-10)), 3) + 0.0 AS neg_log10_p,
           -log10(greatest(p_fdr, 1e-10)) >= -log10(0.05) AS starred
    FROM ({oracle.corrected('profile_pairs', 'target')}) WHERE p_fdr IS NOT NULL""")
def log_p_matrix(spark, sf_dir):
    """Symmetric -log10 of corrected p, floored at 1e-10."""
    return S.log_p_matrix(_profile_tests(spark, sf_dir), ["target"]).select(
        "target", "a", "b", (F.round("neg_log10_p", 3) + 0.0).alias("neg_log10_p"), "starred")


_TWO_WAY = ["any_importance", "patient_importance", "therapist_importance", "therapist_speaking",
            "patient_speaking"]
_TWO_LIST = ", ".join(f"'{c}'" for c in _TWO_WAY)
oracle.add_view("rank_counts", f"""
    SELECT comparison, label, k1, k2, n1, n2, n1 + n2 AS n, k1 + k2 AS o, n1 + n2 - k1 - k2 AS z FROM (
      SELECT comparison, label, CAST(sum(cnt) FILTER (WHERE split = 'important') AS DOUBLE) AS k1,
             CAST(sum(cnt) FILTER (WHERE split <> 'important') AS DOUBLE) AS k2 FROM (
        SELECT comparison, split, label, coalesce(cnt, 0) AS cnt
        FROM (SELECT DISTINCT comparison, label FROM split_counts)
        JOIN (SELECT DISTINCT comparison, split FROM split_counts) USING (comparison)
        LEFT JOIN split_counts USING (comparison, split, label)) WHERE comparison IN ({_TWO_LIST}) GROUP BY ALL)
    JOIN (SELECT comparison, CAST(sum(cnt) FILTER (WHERE split = 'important') AS DOUBLE) AS n1,
                 CAST(sum(cnt) FILTER (WHERE split <> 'important') AS DOUBLE) AS n2
          FROM split_counts GROUP BY ALL) USING (comparison)""")
oracle.add_view("rank_scores", f"""
    SELECT comparison, label, u, CASE WHEN s2 > 1e-9 THEN CASE WHEN score <= 0 THEN 1.0
             ELSE {oracle.chi2_tail('score * score', '1')} END END AS p_value FROM (
      SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(s2) AS score FROM (
        SELECT *, (n1 - k1) * (z + 1) / 2 + k1 * (z + (o + 1) / 2) - n1 * (n1 + 1) / 2 AS u,
               n1 * n2 / 12 * ((n + 1) - (z * z * z - z + o * o * o - o) / (n * (n - 1))) AS s2
        FROM rank_counts))""")


@registered("g06_indicator_rank_tests", f"""
    SELECT comparison, label, round(u, 6) AS u, round(p_value, 6) AS p_value, round(p_fdr, 6) AS p_fdr,
           coalesce(p_fdr < 0.05, false) AS significant FROM ({oracle.corrected('rank_scores', 'comparison')})""")
def indicator_rank_tests(spark, sf_dir):
    """Mann-Whitney U per label for every two-way split, corrected per comparison."""
    counts = (
        D.splits(tables(spark, sf_dir).hub(), _TWO_WAY)
        .groupBy("comparison", "split", F.col("proc_da").alias("label")).agg(F.count("*").alias("cnt"))
    )
    tests = S.indicator_rank_test(counts, ["comparison"], "important", "nonimportant")
    return benjamini_hochberg(tests, ["comparison"]).select(
        "comparison", "label", *[r6(c).alias(c) for c in ("u", "p_value", "p_fdr")], "significant")


oracle.add_view("patterns", f"""
    WITH g AS (SELECT *, coalesce({oracle.core('proc_da')}, '') AS cg FROM hub),
    f AS (SELECT *, cg IN ('canonical_questions', 'non_canonical_questions') AS q, cg IN ('statements', 'hedge') AS r FROM g),
    l AS (SELECT *, q AND coalesce(lead(r) OVER (PARTITION BY source_file ORDER BY pos), false) AS is_pattern_question FROM f),
    a AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY source_file ORDER BY pos) AS anchor FROM l),
    b AS (SELECT *, bool_or(is_pattern_question) OVER (PARTITION BY source_file, anchor) AS anchored,
                 sum(CAST(is_pattern_question AS INT)) OVER (PARTITION BY source_file ORDER BY pos) AS seen FROM a)
    SELECT source_file, pos, speaker, patient, therapist, is_pattern_question, r AND anchor > 0 AND anchored AS is_pattern_response,
           CASE WHEN is_pattern_question OR (r AND anchor > 0 AND anchored) THEN seen - 1 END AS pattern_id FROM b""")
oracle.add_view("pattern_rows", """
    WITH s AS (SELECT source_file, pattern_id, speaker, count(*) AS k FROM patterns WHERE is_pattern_response GROUP BY ALL)
    SELECT r.source_file, CAST(r.pattern_id AS BIGINT) AS pattern_id, CAST(r.run_length AS BIGINT) AS run_length,
           r.response_speaker, q.speaker AS question_speaker,
           CAST(q.patient AS INT) AS patient_important, CAST(q.therapist AS INT) AS therapist_important
    FROM (SELECT source_file, pattern_id, sum(k) AS run_length, arg_min(speaker, (-k, speaker)) AS response_speaker
          FROM s GROUP BY ALL) r
    JOIN (SELECT * FROM patterns WHERE is_pattern_question) q USING (source_file, pattern_id)""")


@registered("h01_question_responses", """
    SELECT source_file, pos, is_pattern_question, is_pattern_response, CAST(pattern_id AS BIGINT) AS pattern_id
    FROM patterns WHERE pattern_id IS NOT NULL""")
def question_responses(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.label_patterns(t.hub(), t.order).filter(F.col("pattern_id").isNotNull()).select(
        "source_file", "pos", "is_pattern_question", "is_pattern_response", "pattern_id")


def _patterns(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.pattern_table(R.label_patterns(t.hub(), t.order))


@registered("h02_patterns", "SELECT * FROM pattern_rows")
def patterns(spark, sf_dir):
    return _patterns(spark, sf_dir)


oracle.add_view("pattern_sides", """
    SELECT *, 'patient' AS target, patient_important = 1 AS important FROM pattern_rows
    UNION ALL SELECT *, 'therapist', therapist_important = 1 FROM pattern_rows""")
oracle.add_view("pattern_combos", """
    SELECT *, 'all' AS combo FROM pattern_sides
    UNION ALL SELECT *, left(question_speaker, 1) || ' asks, ' || left(response_speaker, 1) || ' responds' FROM pattern_sides""")


def _combos(spark, sf_dir):
    """Patterns once overall and once in their speaker combination, per target."""
    rows = _patterns(spark, sf_dir)
    combo = F.concat(F.left("question_speaker", F.lit(1)), F.lit(" asks, "),
                     F.left("response_speaker", F.lit(1)), F.lit(" responds"))
    return (
        rows.withColumn("combo", F.explode(F.array(F.lit("all"), combo)))
        .select("*", F.inline(F.array(
            F.struct(F.lit("patient").alias("target"), (F.col("patient_important") == 1).alias("important")),
            F.struct(F.lit("therapist").alias("target"), (F.col("therapist_important") == 1).alias("important")),
        )))
    )


@registered("h03_speaker_combinations", """
    SELECT target, combo, important, count(*) AS n_patterns, CAST(sum(run_length) AS BIGINT) AS n_responses
    FROM pattern_combos GROUP BY ALL""")
def speaker_combinations(spark, sf_dir):
    return _combos(spark, sf_dir).groupBy("target", "combo", "important").agg(
        F.count("*").alias("n_patterns"), F.sum("run_length").alias("n_responses"))


oracle.add_view("run_ranks", """
    SELECT target, combo, run_length, important, avg(rn) OVER (PARTITION BY target, combo, run_length) AS rank,
           count(*) OVER (PARTITION BY target, combo, run_length) AS tied
    FROM (SELECT *, row_number() OVER (PARTITION BY target, combo ORDER BY run_length) AS rn FROM pattern_combos)""")
oracle.add_view("run_tests", f"""
    SELECT target, combo, n1, n2, CASE WHEN n1 >= 2 AND n2 >= 2 THEN u END AS u,
           CASE WHEN n1 >= 2 AND n2 >= 2 AND s2 > 1e-9 THEN CASE WHEN score <= 0 THEN 1.0
             ELSE {oracle.chi2_tail('score * score', '1')} END END AS p_value FROM (
      SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(s2) AS score FROM (
        SELECT *, n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS s2 FROM (
          SELECT target, combo, CAST(count(*) FILTER (WHERE important) AS DOUBLE) AS n1,
                 CAST(count(*) FILTER (WHERE NOT important) AS DOUBLE) AS n2,
                 coalesce(sum(rank) FILTER (WHERE important), 0) - count(*) FILTER (WHERE important)
                   * (count(*) FILTER (WHERE important) + 1) / 2 AS u,
                 CAST(sum(tied * tied - 1) AS DOUBLE) AS ties
          FROM run_ranks GROUP BY ALL)))""")


@registered("g07_run_length_tests", """
    SELECT t.target, t.combo, n1, n2, round(u, 6) AS u, round(p_value, 6) AS p_value,
           round(avg(run_length) FILTER (WHERE important), 6) AS mean_important,
           median(run_length) FILTER (WHERE important) AS median_important,
           max(run_length) FILTER (WHERE important) AS max_important,
           round(avg(run_length) FILTER (WHERE NOT important), 6) AS mean_other,
           median(run_length) FILTER (WHERE NOT important) AS median_other,
           max(run_length) FILTER (WHERE NOT important) AS max_other
    FROM run_tests t JOIN pattern_combos c ON t.target = c.target AND t.combo = c.combo GROUP BY ALL""")
def run_length_tests(spark, sf_dir):
    """Mann-Whitney U of response run lengths, important against other patterns."""
    tests = S.rank_test(_combos(spark, sf_dir), ["target", "combo"], "run_length", F.col("important"))
    return tests.select(
        "target", "combo", "n1", "n2", r6("u").alias("u"), r6("p_value").alias("p_value"),
        *[c for side in ("important", "other") for c in (
            r6(f"mean_{side}").alias(f"mean_{side}"), f"median_{side}", f"max_{side}")])


@registered("g08_run_length_histogram", """
    SELECT target, combo, run_length, count(*) FILTER (WHERE important) AS n_important,
           count(*) FILTER (WHERE NOT important) AS n_other FROM (
      SELECT target, combo, important, run_length FROM pattern_combos
      UNION ALL SELECT target, combo, NULL, unnest(range(1, max(run_length) + 1)) FROM pattern_combos GROUP BY target, combo)
    GROUP BY ALL""")
def run_length_histogram(spark, sf_dir):
    """Unit bins from 1 to the longest run, empty bins included."""
    rows = _combos(spark, sf_dir)
    counts = rows.groupBy("target", "combo", "run_length").agg(
        F.count_if("important").alias("n_important"), F.count_if(~F.col("important")).alias("n_other"))
    bins = counts.groupBy("target", "combo").agg(F.max("run_length").alias("_last")).select(
        "target", "combo", F.explode(F.sequence(F.lit(1).cast("long"), "_last")).alias("run_length"))
    return bins.join(counts, ["target", "combo", "run_length"], "left").fillna(0)
