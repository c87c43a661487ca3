"""Queries over rater consistency (inventory K, with F18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import agreement as A
from turnloom.operators import pairs as P
from turnloom.plans import oracle
from turnloom.plans.registry import registered
from turnloom.plans.tables import tables
from turnloom.plans.testing import _pair_sql

TARGET = "patient"
SIZES = (1, 2, 3)


def r4(column):
    return F.round(column, 4)


def r6(column):
    return F.round(column, 6)


def counts(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.once("rater_counts", lambda: A.rater_counts(
        t.hub(), t.block_codes(TARGET), t.order, TARGET, sizes=SIZES))


def sequences(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.once("rater_sequences", lambda: A.rater_sequences(
        t.hub(), t.block_codes(TARGET), t.order, TARGET))


def coded_labels(spark, sf_dir) -> DataFrame:
    return counts(spark, sf_dir).filter((F.col("kind") == "code") & (F.col("n") == 1))


_SLICED = """
    SELECT 'all' AS slice, rater, source_file, {seq} AS seq, pos, da_group AS label FROM kept WHERE {seq} IS NOT NULL
    UNION ALL SELECT CASE WHEN speaker = 'Therapist' THEN 'therapist_spkr' ELSE 'patient_spkr' END,
      rater, source_file, {seq}, pos, da_group FROM kept WHERE {seq} IS NOT NULL"""
oracle.add_view("kept", "SELECT * FROM hub SEMI JOIN patient_blocks USING (source_file)")
oracle.add_view("imp_rows", _SLICED.format(seq="patient_start"))
oracle.add_view("rest_rows", _SLICED.format(seq="patient_rest_start"))
for _kind in ("imp", "rest"):
    oracle.add_view(f"{_kind}_grams", oracle._grams(
        f"{_kind}_rows", "slice, source_file, seq", SIZES, "slice, rater, source_file, seq"))
oracle.add_view("rated", """
    SELECT 'code' AS kind, slice, rater, g.source_file, code, n, ngram, count(*) AS cnt
    FROM imp_grams g JOIN patient_codes c ON g.source_file = c.source_file AND g.seq = c.block_start GROUP BY ALL
    UNION ALL SELECT 'important', slice, rater, source_file, NULL, n, ngram, count(*) FROM imp_grams GROUP BY ALL
    UNION ALL SELECT 'rest', slice, rater, source_file, NULL, n, ngram, count(*) FROM rest_grams GROUP BY ALL""")
oracle.add_view("rated_seqs", """
    SELECT 'code' AS kind, slice, rater, s.source_file, code, count(*) AS n_seqs
    FROM (SELECT DISTINCT slice, rater, source_file, seq FROM imp_rows) s
    JOIN patient_codes c ON s.source_file = c.source_file AND s.seq = c.block_start GROUP BY ALL
    UNION ALL SELECT 'important', slice, rater, source_file, NULL, count(DISTINCT seq) FROM imp_rows GROUP BY ALL
    UNION ALL SELECT 'rest', v.slice, rater, source_file, NULL, count(DISTINCT seq)
    FROM rest_rows, (VALUES ('all'), ('therapist_spkr'), ('patient_spkr')) v(slice) GROUP BY ALL""")
oracle.add_view("coded_by_rater", """
    SELECT slice, code, rater, n, ngram, sum(cnt) AS cnt FROM rated WHERE kind = 'code' GROUP BY ALL""")
oracle.add_view("coded_labels", """
    SELECT slice, code, rater, ngram, cnt FROM coded_by_rater WHERE n = 1""")


@registered("f18_code_distributions", """
    SELECT slice, code, rater, ngram AS label, CAST(cnt AS BIGINT) AS cnt,
           CAST(sum(cnt) OVER (PARTITION BY slice, code, rater) AS BIGINT) AS n_das, CAST(n_seqs AS BIGINT) AS n_sequences,
           round(cnt / sum(cnt) OVER (PARTITION BY slice, code, rater), 6) AS share
    FROM coded_labels JOIN (SELECT slice, code, rater, sum(n_seqs) AS n_seqs FROM rated_seqs WHERE kind = 'code' GROUP BY ALL)
      USING (slice, code, rater)""")
def code_distributions(spark, sf_dir):
    keys = ["slice", "code", "rater"]
    labels = A.pooled_over(coded_labels(spark, sf_dir), *keys, "ngram")
    totals = labels.groupBy(*keys).agg(F.sum("cnt").alias("n_das"))
    n_seqs = sequences(spark, sf_dir).filter(F.col("kind") == "code").groupBy(*keys).agg(
        F.sum("n_seqs").alias("n_sequences"))
    return labels.join(totals, keys).join(n_seqs, keys).select(
        *keys, F.col("ngram").alias("label"), "cnt", "n_das", "n_sequences",
        r6(F.col("cnt") / F.col("n_das")).alias("share"))


oracle.add_view("session_rates", """
    SELECT rater, source_file, count(*) AS n_das, count(*) FILTER (WHERE patient) AS n_important,
           count(*) FILTER (WHERE patient) / count(*) AS rate FROM hub GROUP BY ALL HAVING n_important > 0""")


@registered("k01_session_rates", """
    SELECT rater, source_file, n_das, n_important, round(rate, 4) AS rate FROM session_rates""")
def session_rates(spark, sf_dir):
    return A.session_rates(tables(spark, sf_dir).hub(), TARGET).withColumn("rate", r4("rate"))


@registered("k02_rate_summary", """
    SELECT rater, count(*) AS n_sessions, round(avg(round(rate, 4)), 4) AS mean_rate,
           round(stddev_samp(round(rate, 4)), 4) AS std_rate, min(round(rate, 4)) AS min_rate, max(round(rate, 4)) AS max_rate
    FROM session_rates GROUP BY ALL""")
def rate_summary(spark, sf_dir):
    summary = A.rate_summary(A.session_rates(tables(spark, sf_dir).hub(), TARGET))
    return summary.select("rater", "n_sessions", *[
        r4(c).alias(c) for c in ("mean_rate", "std_rate", "min_rate", "max_rate")])


@registered("k03_rate_consistency", """
    WITH p AS (SELECT x.rater, avg((x.rate - y.rate) ** 2) AS d_o FROM session_rates x JOIN session_rates y
               ON x.rater = y.rater AND x.source_file < y.source_file GROUP BY ALL),
    w AS (SELECT sum(s / (n - 1)) AS within, sum(n) AS m FROM (
            SELECT x.rater, sum((x.rate - y.rate) ** 2) AS s, sqrt(count(*)) AS n
            FROM session_rates x JOIN session_rates y ON x.rater = y.rater GROUP BY ALL) WHERE n >= 2),
    t AS (SELECT sum((x.rate - y.rate) ** 2) AS all_pairs FROM session_rates x, session_rates y
          WHERE x.rater IN (SELECT rater FROM p) AND y.rater IN (SELECT rater FROM p))
    SELECT rater, count(*) AS n_sessions, round(avg(rate), 4) AS mean_rate, round(stddev_pop(rate), 4) AS std_rate,
           round(max(1 - d_o / v), 4) AS alpha_within, round(max(1 - (within / m) / (all_pairs / (m * (m - 1)))), 4) AS alpha_between,
           'unreliable' AS note
    FROM session_rates JOIN p USING (rater) JOIN (SELECT rater, var_samp(rate) AS v FROM session_rates GROUP BY ALL) USING (rater), w, t
    GROUP BY rater""")
def rate_consistency(spark, sf_dir):
    return A.rate_consistency(A.session_rates(tables(spark, sf_dir).hub(), TARGET)).select(
        "rater", "n_sessions", *[r4(c).alias(c) for c in (
            "mean_rate", "std_rate", "alpha_within", "alpha_between")], "note")


def _tests_sql(source: str, keys: str, group: str) -> str:
    return f"""
      SELECT {keys}, a, b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(chi2 + 1e-9, 6) AS chi2, CAST(dof AS BIGINT) AS dof,
             round({oracle.chi2_tail('chi2', 'dof')}, 6) AS p_value, round(CASE WHEN chi2 IS NOT NULL THEN js END, 6) AS js
      FROM ({_pair_sql(source, keys, group, 'ngram')})"""


def _tests(df: DataFrame, *keys: str) -> DataFrame:
    # chi2 of small counts is often a decimal ending in 5; 1e-9 rounds those up in every engine
    return df.select(
        *keys, "a", "b", "n_a", "n_b", r6(F.col("chi2") + 1e-9).alias("chi2"), F.col("dof").cast("long").alias("dof"),
        r6("p_value").alias("p_value"), r6("js").alias("js"))


def _between(spark, sf_dir):
    def build():
        labels = A.pooled_over(coded_labels(spark, sf_dir), "slice", "code", "rater", "ngram")
        return A.compare(labels, ["slice", "code"], "rater")

    return tables(spark, sf_dir).once("between_raters", build)


oracle.add_view("between_pairs", _pair_sql("coded_labels", "slice, code", "rater", "ngram"))
oracle.add_view("between_tests", _tests_sql("coded_labels", "slice, code", "rater"))


@registered("k04_between_raters", "SELECT * FROM between_tests")
def between_raters(spark, sf_dir):
    """Pairwise tests between raters on the label counts of a code."""
    return _tests(_between(spark, sf_dir), "slice", "code")


oracle.add_view("rater_sides", f"""
    SELECT slice, code, a, side, n, ngram, CASE side WHEN '1' THEN own ELSE total - own END AS cnt FROM (
      SELECT t.slice, t.code, t.n, t.ngram, g.rater AS a, t.total, coalesce(c.cnt, 0) AS own
      FROM (SELECT slice, code, n, ngram, sum(cnt) AS total FROM coded_by_rater GROUP BY ALL) t
      JOIN (SELECT DISTINCT slice, code, rater FROM coded_by_rater) g USING (slice, code)
      LEFT JOIN coded_by_rater c ON c.slice = t.slice AND c.code = t.code AND c.rater = g.rater
       AND c.n = t.n AND c.ngram = t.ngram),
    (VALUES ('1'), ('2')) v(side) WHERE CASE side WHEN '1' THEN own ELSE total - own END > 0""")
oracle.add_view("rater_label_sides", """
    SELECT slice, code, a AS rater, side, ngram, cnt FROM rater_sides WHERE n = 1""")
oracle.add_view("rater_rest_pairs", _pair_sql("rater_label_sides", "slice, code, rater", "side", "ngram"))
oracle.add_view("rater_rest_tests", f"""
    SELECT * EXCLUDE (rater) REPLACE (rater AS a, '{A.OTHER_RATERS}' AS b)
    FROM ({_tests_sql('rater_label_sides', 'slice, code, rater', 'side')})""")


def _against_others(spark, sf_dir):
    return tables(spark, sf_dir).once(
        "raters_against_others", lambda: A.raters_against_others(counts(spark, sf_dir)))


@registered("k04_raters_against_others", "SELECT * FROM rater_rest_tests")
def raters_against_others(spark, sf_dir):
    """K4 in linear form: every rater of a code against the code's other raters."""
    return _tests(_against_others(spark, sf_dir), "slice", "code")


oracle.add_view("coded_by_session", """
    SELECT slice, code, rater, source_file, ngram, cnt FROM rated WHERE kind = 'code' AND n = 1""")
oracle.add_view("session_sides", f"""
    SELECT o.slice, o.code, o.rater, g.source_file, side, ngram, CASE side WHEN 'a' THEN own ELSE total - own END AS cnt FROM (
      SELECT t.*, g.source_file, coalesce(c.cnt, 0) AS own FROM (
        SELECT slice, code, rater, ngram, sum(cnt) AS total FROM coded_by_session GROUP BY ALL) t
      JOIN (SELECT DISTINCT slice, code, rater, source_file FROM coded_by_session) g USING (slice, code, rater)
      LEFT JOIN coded_by_session c USING (slice, code, rater, source_file, ngram)) o
    JOIN (SELECT DISTINCT slice, code, rater, source_file FROM coded_by_session) g USING (slice, code, rater, source_file),
    (VALUES ('a'), ('b')) v(side) WHERE CASE side WHEN 'a' THEN own ELSE total - own END > 0""")
oracle.add_view("rest_tests", f"""
    SELECT * EXCLUDE (source_file) REPLACE (source_file AS a, '{A.OTHER_SESSIONS}' AS b)
    FROM ({_tests_sql('session_sides', 'slice, code, rater, source_file', 'side')})""")


def _within(spark, sf_dir):
    return tables(spark, sf_dir).once(
        "within_raters", lambda: A.within_raters(coded_labels(spark, sf_dir)))


@registered("k05_within_raters", "SELECT * FROM rest_tests")
def within_raters(spark, sf_dir):
    """Every session against the other sessions of its rater."""
    return _tests(_within(spark, sf_dir), "slice", "code", "rater")


@registered("k05_sessions_against_rest", "SELECT * FROM rest_tests")
def sessions_against_rest(spark, sf_dir):
    """The same comparison straight from the counts, without the stored table."""
    return _tests(A.within_raters(coded_labels(spark, sf_dir)), "slice", "code", "rater")


@registered("k06_rater_divergence_matrix", """
    WITH g AS (SELECT DISTINCT slice, rater FROM coded_labels), c AS (SELECT DISTINCT slice, code FROM coded_labels)
    SELECT g.slice, c.code, g.rater AS a, h.rater AS b, round(p.js, 4) AS js
    FROM g JOIN g h ON g.slice = h.slice AND g.rater <> h.rater JOIN c ON c.slice = g.slice
    LEFT JOIN between_pairs p ON p.slice = g.slice AND p.code = c.code
     AND p.a = least(g.rater, h.rater) AND p.b = greatest(g.rater, h.rater)""")
def rater_divergence_matrix(spark, sf_dir):
    """Rater by rater divergence per code, null where one has no data for the code."""
    labels = A.pooled_over(coded_labels(spark, sf_dir), "slice", "code", "rater", "ngram")
    js = P.count_divergence(labels, ["slice", "code"], "rater", "ngram", "cnt")
    raters = labels.select("slice", "rater").distinct()
    grid = P.all_pairs(raters, ["slice"], "rater").join(
        labels.select("slice", "code").distinct(), "slice")
    return grid.join(js, ["slice", "code", "a", "b"], "left").select(
        "slice", "code", r4("js").alias("js"), F.inline(F.array(
            F.struct(F.col("a").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


@registered("k06_divergence_from_others", f"""
    SELECT g.slice, c.code, g.rater AS a, '{A.OTHER_RATERS}' AS b, round(p.js, 4) AS js
    FROM (SELECT DISTINCT slice, rater FROM coded_labels) g
    JOIN (SELECT DISTINCT slice, code FROM coded_labels) c USING (slice)
    LEFT JOIN rater_rest_pairs p ON p.slice = g.slice AND p.code = c.code AND p.rater = g.rater""")
def divergence_from_others(spark, sf_dir):
    """K6 in linear form: one row per code and rater, null where the rater or all others lack data for the code."""
    labels = coded_labels(spark, sf_dir)
    codes = labels.groupBy("slice").agg(F.collect_set("code").alias("codes"))  # a set of names
    grid = labels.select("slice", "rater").distinct().join(codes, "slice").select(
        "slice", F.explode("codes").alias("code"), F.col("rater").alias("a"), F.lit(A.OTHER_RATERS).alias("b"))
    js = _against_others(spark, sf_dir).select("slice", "code", "a", r4("js_any").alias("js"))
    return grid.join(js, ["slice", "code", "a"], "left").select("slice", "code", "a", "b", "js")


oracle.add_view("code_pairs_by_rater", _pair_sql("coded_labels", "slice, rater", "code", "ngram"))


@registered("k07_code_divergence_by_rater", """
    SELECT slice, rater, a, b, round(js, 4) AS js FROM code_pairs_by_rater""")
def code_divergence_by_rater(spark, sf_dir):
    labels = A.pooled_over(coded_labels(spark, sf_dir), "slice", "rater", "code", "ngram")
    return P.count_divergence(labels, ["slice", "rater"], "code", "ngram", "cnt").withColumn("js", r4("js"))


oracle.add_view("labels_by_code", "SELECT slice, code, ngram, sum(cnt) AS cnt FROM coded_labels GROUP BY ALL")


@registered("k08_cross_code_tests", _tests_sql("labels_by_code", "slice", "code"))
def cross_code_tests(spark, sf_dir):
    labels = A.pooled_over(coded_labels(spark, sf_dir), "slice", "code", "ngram")
    return _tests(A.compare(labels, ["slice"], "code"), "slice").orderBy("slice", F.col("js").desc())


def _divergences_sql(source: str, keys: str, group: str) -> str:
    joined = "\n".join(
        f"LEFT JOIN (SELECT {keys}, a, b, js AS js_{n}gram FROM (SELECT * FROM ("
        f"{_pair_sql(f'(SELECT * FROM {source} WHERE n = {n})', keys, group, 'ngram')}))) s{n} USING ({keys}, a, b)"
        for n in SIZES)
    both = f"(SELECT *, n || ':' || ngram AS f FROM {source})"
    return f"""
      SELECT * FROM (SELECT {keys}, a, b, js AS js_freq FROM ({_pair_sql(f'(SELECT * FROM {source} WHERE n = 1)', keys, group, 'ngram')}))
      JOIN (SELECT {keys}, a, b, js AS js_combined FROM ({_pair_sql(both, keys, group, 'f')})) USING ({keys}, a, b)
      {joined}"""


oracle.add_view("rater_js", _divergences_sql("coded_by_rater", "slice, code", "rater"))
_JS_ROUNDED = "round(js_freq, 4) AS js_freq, round(js_combined, 4) AS js_combined_ngram, " + ", ".join(
    f"round(js_{n}gram, 4) AS js_{n}gram" for n in SIZES)
oracle.add_view("rater_ceilings", f"""
    SELECT slice, code, a, b, {_JS_ROUNDED},
           round(greatest(0, 1 - js_freq), 4) AS kappa_analogue, round((1 + greatest(0, 1 - js_freq)) / 2, 4) AS f1_ceiling,
           round(greatest(0, 1 - js_combined), 4) AS kappa_combined_ngram,
           round((1 + greatest(0, 1 - js_combined)) / 2, 4) AS f1_ceiling_ngram,
           CAST(x.k AS BIGINT) AS n_seqs_a, CAST(y.k AS BIGINT) AS n_seqs_b
    FROM rater_js
    JOIN (SELECT slice, code, rater AS a, sum(n_seqs) AS k FROM rated_seqs WHERE kind = 'code' GROUP BY ALL) x USING (slice, code, a)
    JOIN (SELECT slice, code, rater AS b, sum(n_seqs) AS k FROM rated_seqs WHERE kind = 'code' GROUP BY ALL) y USING (slice, code, b)""")
_JS = ["js_freq", "js_combined_ngram", *[f"js_{n}gram" for n in SIZES]]


def _ceilings(spark, sf_dir):
    return A.rater_ceilings(counts(spark, sf_dir), sequences(spark, sf_dir), SIZES)


@registered("k13_rater_ceilings", "SELECT * FROM rater_ceilings")
def rater_ceilings(spark, sf_dir):
    """Divergences (K9, K10, K11), kappa and F1 ceiling (K12) per pair of raters."""
    return _ceilings(spark, sf_dir).select(
        "slice", "code", "a", "b", "n_seqs_a", "n_seqs_b", *[r4(c).alias(c) for c in (
            *_JS, "kappa_analogue", "f1_ceiling", "kappa_combined_ngram", "f1_ceiling_ngram")])


oracle.add_view("rater_rest_counts", "SELECT slice, code, a AS rater, side, n, ngram, cnt FROM rater_sides")
oracle.add_view("rater_rest_js", _divergences_sql("rater_rest_counts", "slice, code, rater", "side"))


oracle.add_view("rater_rest_ceilings", f"""
    SELECT slice, code, rater AS a, '{A.OTHER_RATERS}' AS b, {_JS_ROUNDED},
           round(greatest(0, 1 - js_freq), 4) AS kappa_analogue, round((1 + greatest(0, 1 - js_freq)) / 2, 4) AS f1_ceiling,
           round(greatest(0, 1 - js_combined), 4) AS kappa_combined_ngram,
           round((1 + greatest(0, 1 - js_combined)) / 2, 4) AS f1_ceiling_ngram,
           CAST(k AS BIGINT) AS n_seqs_a, CAST(k_all - k AS BIGINT) AS n_seqs_b
    FROM rater_rest_js
    JOIN (SELECT *, sum(k) OVER (PARTITION BY slice, code) AS k_all FROM (
            SELECT slice, code, rater, sum(n_seqs) AS k FROM rated_seqs WHERE kind = 'code' GROUP BY ALL))
      USING (slice, code, rater)""")


@registered("k13_ceilings_against_others", "SELECT * FROM rater_rest_ceilings")
def ceilings_against_others(spark, sf_dir):
    """K13 in linear form: one row per rater of a code."""
    return A.ceilings_against_others(counts(spark, sf_dir), sequences(spark, sf_dir), SIZES).select(
        "slice", "code", "a", "b", "n_seqs_a", "n_seqs_b", *[r4(c).alias(c) for c in (
            *_JS, "kappa_analogue", "f1_ceiling", "kappa_combined_ngram", "f1_ceiling_ngram")])


_NGRAM_STATS = ", ".join(
    f"round(avg(js_{n}gram), 6) AS mean_js_{n}gram, min(js_{n}gram) AS min_js_{n}gram, max(js_{n}gram) AS max_js_{n}gram"
    for n in SIZES)


def _summary_sql(ceilings: str) -> str:
    return f"""
    SELECT slice, code, {_NGRAM_STATS}, round(avg(js_freq), 6) AS mean_js, round(avg(kappa_analogue), 6) AS mean_kappa,
           round(avg(f1_ceiling), 6) AS mean_f1, min(f1_ceiling) AS min_f1, max(f1_ceiling) AS max_f1,
           CASE WHEN avg(kappa_analogue) > 0.8 THEN 'CONSISTENT' WHEN avg(kappa_analogue) > 0.6 THEN 'MODERATE'
                WHEN avg(kappa_analogue) > 0.4 THEN 'NOISY' ELSE 'HIGH NOISE' END AS band
    FROM (SELECT * FROM {ceilings} UNION ALL SELECT * REPLACE ('pooled' AS code) FROM {ceilings}) GROUP BY slice, code"""


def _summary(ceilings: DataFrame) -> DataFrame:
    return A.ceiling_summary(ceilings, SIZES).select(
        "slice", "code", *[r6(c).alias(c) for c in (
            "mean_js", "mean_kappa", "mean_f1", *[f"mean_js_{n}gram" for n in SIZES])],
        *[f"{side}_js_{n}gram" for n in SIZES for side in ("min", "max")], "min_f1", "max_f1", "band")


@registered("k14_ceiling_summary", _summary_sql("rater_ceilings"))
def ceiling_summary(spark, sf_dir):
    return _summary(_ceilings(spark, sf_dir))


@registered("k14_summary_against_others", _summary_sql("rater_rest_ceilings"))
def summary_against_others(spark, sf_dir):
    """K14 over the linear form of the ceilings: its input has one row per rater of a code."""
    return _summary(A.ceilings_against_others(counts(spark, sf_dir), sequences(spark, sf_dir), SIZES))


oracle.add_view("imp_rest", """
    SELECT slice, unnest([rater, 'pooled']) AS rater, kind, n, ngram, cnt FROM rated WHERE kind <> 'code'""")
oracle.add_view("imp_rest_counts", "SELECT slice, rater, kind, n, ngram, sum(cnt) AS cnt FROM imp_rest GROUP BY ALL")
oracle.add_view("imp_rest_js", _divergences_sql("imp_rest_counts", "slice, rater", "kind"))


@registered("k15_important_against_rest", f"""
    SELECT slice, rater, {_JS_ROUNDED}, round(js_freq, 4) AS kappa, round((1 + js_freq) / 2, 4) AS f1_ceiling,
           round((1 + js_combined) / 2, 4) AS f1_ceiling_ngram, CAST(n_important AS BIGINT) AS n_important, CAST(n_rest AS BIGINT) AS n_rest
    FROM imp_rest_js JOIN (
      SELECT slice, rater, sum(n_seqs) FILTER (WHERE kind = 'important') AS n_important, sum(n_seqs) FILTER (WHERE kind = 'rest') AS n_rest
      FROM (SELECT * FROM rated_seqs UNION ALL SELECT * REPLACE ('pooled' AS rater) FROM rated_seqs) GROUP BY ALL) USING (slice, rater)""")
def important_against_rest(spark, sf_dir):
    out = A.important_against_rest(counts(spark, sf_dir), sequences(spark, sf_dir), SIZES)
    return out.select("slice", "rater", "n_important", "n_rest", *[
        r4(c).alias(c) for c in (*_JS, "kappa", "f1_ceiling", "f1_ceiling_ngram")])


oracle.add_view("coded_pooled", """
    SELECT slice, rater, code, ngram, sum(cnt) AS cnt FROM (
      SELECT slice, unnest([rater, 'pooled']) AS rater, code, ngram, cnt FROM coded_labels) GROUP BY ALL""")
oracle.add_view("coded_pooled_pairs", _pair_sql("coded_pooled", "slice, rater", "code", "ngram"))
oracle.add_view("coded_seqs", """
    SELECT slice, rater, code, CAST(sum(n_seqs) AS BIGINT) AS k FROM (
      SELECT slice, unnest([rater, 'pooled']) AS rater, code, n_seqs FROM rated_seqs WHERE kind = 'code') GROUP BY ALL""")


@registered("k16_code_discrimination", """
    SELECT p.slice, p.rater, p.a, p.b, round(js, 4) AS js, round(greatest(0, 1 - js), 4) AS kappa,
           round((1 + greatest(0, 1 - js)) / 2, 4) AS f1_ceiling, round(js, 4) AS separability, x.k AS n_a, y.k AS n_b
    FROM coded_pooled_pairs p
    JOIN coded_seqs x ON x.slice = p.slice AND x.rater = p.rater AND x.code = p.a
    JOIN coded_seqs y ON y.slice = p.slice AND y.rater = p.rater AND y.code = p.b""")
def code_discrimination(spark, sf_dir):
    out = A.code_discrimination(counts(spark, sf_dir), sequences(spark, sf_dir))
    return out.select("slice", "rater", "a", "b", "n_a", "n_b", *[
        r4(c).alias(c) for c in ("js", "kappa", "f1_ceiling", "separability")])


@registered("k16_discrimination_summary", """
    SELECT slice, rater, round(avg(js), 4) AS mean_js, count(*) AS n_pairs, round(greatest(0, 1 - avg(js)), 4) AS kappa,
           round((1 + greatest(0, 1 - avg(js))) / 2, 4) AS f1_ceiling FROM coded_pooled_pairs GROUP BY slice, rater""")
def discrimination_summary(spark, sf_dir):
    out = A.discrimination_summary(A.code_discrimination(counts(spark, sf_dir), sequences(spark, sf_dir)))
    return out.select("slice", "rater", "n_pairs", *[r4(c).alias(c) for c in ("mean_js", "kappa", "f1_ceiling")])


oracle.add_view("sides", """
    WITH own AS (SELECT slice, code, n, ngram, sum(cnt) AS cnt FROM coded_by_rater GROUP BY ALL),
    rest AS (SELECT slice, n, ngram, sum(cnt) AS cnt FROM rated WHERE kind = 'rest' GROUP BY ALL),
    codes AS (SELECT DISTINCT slice, code FROM own)
    SELECT slice, code, 'code' AS side, n, ngram, cnt FROM own
    UNION ALL SELECT c.slice, c.code, 'others', o.n, o.ngram, sum(o.cnt) FROM codes c JOIN (
      SELECT slice, code, n, ngram, cnt FROM own UNION ALL SELECT slice, '(rest)', n, ngram, cnt FROM rest) o
      ON o.slice = c.slice AND o.code <> c.code GROUP BY ALL""")
oracle.add_view("sides_js", _divergences_sql("sides", "slice, code", "side"))


@registered("k17_code_against_others", f"""
    SELECT slice, code, {_JS_ROUNDED}, round(js_freq, 4) AS kappa_freq, round((1 + js_freq) / 2, 4) AS f1_ceiling_freq,
           round((1 + js_combined) / 2, 4) AS f1_ceiling_ngram, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_all - n_pos AS BIGINT) AS n_neg
    FROM sides_js JOIN (SELECT slice, code, sum(n_seqs) AS n_pos FROM rated_seqs WHERE kind = 'code' GROUP BY ALL) USING (slice, code)
    JOIN (SELECT slice, sum(n_seqs) AS n_all FROM rated_seqs WHERE kind <> 'important' GROUP BY ALL) USING (slice)""")
def code_against_others(spark, sf_dir):
    out = A.code_against_others(counts(spark, sf_dir), sequences(spark, sf_dir), SIZES)
    return out.select("slice", "code", "n_pos", "n_neg", *[
        r4(c).alias(c) for c in (*_JS, "kappa_freq", "f1_ceiling_freq", "f1_ceiling_ngram")])


@registered("k18_agreement_verdicts", f"""
    SELECT slice, code, a, b, round(js, 4) AS js, CASE WHEN js < 0.3 THEN 'AGREE' WHEN js > 0.5 THEN 'DISAGREE' ELSE 'MIXED' END AS verdict,
           coalesce(round({oracle.chi2_tail('chi2', 'dof')}, 6) < 0.05, false) AS significant
    FROM between_pairs""")
def agreement_verdicts(spark, sf_dir):
    return _between(spark, sf_dir).select(
        "slice", "code", "a", "b", r4("js_any").alias("js"), A.verdict(F.col("js_any")).alias("verdict"),
        F.coalesce(r6("p_value") < 0.05, F.lit(False)).alias("significant"))


@registered("k18_verdicts_against_others", f"""
    SELECT slice, code, rater AS a, '{A.OTHER_RATERS}' AS b, round(js, 4) AS js,
           CASE WHEN js < 0.3 THEN 'AGREE' WHEN js > 0.5 THEN 'DISAGREE' ELSE 'MIXED' END AS verdict,
           coalesce(round({oracle.chi2_tail('chi2', 'dof')}, 6) < 0.05, false) AS significant
    FROM rater_rest_pairs""")
def verdicts_against_others(spark, sf_dir):
    """K18 in linear form: whether a rater of a code agrees with the code's other raters."""
    return _against_others(spark, sf_dir).select(
        "slice", "code", "a", "b", r4("js_any").alias("js"), A.verdict(F.col("js_any")).alias("verdict"),
        F.coalesce(r6("p_value") < 0.05, F.lit(False)).alias("significant"))


oracle.add_view("who_counts", "SELECT slice, rater || '|' || code AS who, ngram, cnt FROM coded_labels")
oracle.add_view("who_pairs", _pair_sql("who_counts", "slice", "who", "ngram"))


@registered("k19_ranked_similarity", """
    SELECT slice, split_part(x, '|', 1) AS t_a, split_part(x, '|', 2) AS code_a, split_part(y, '|', 1) AS t_b,
           split_part(y, '|', 2) AS code_b, CAST(nx AS BIGINT) AS n_a, CAST(ny AS BIGINT) AS n_b, round(js, 4) AS js,
           split_part(x, '|', 2) = split_part(y, '|', 2) AS same_code
    FROM (SELECT slice, unnest([a, b]) AS x, unnest([b, a]) AS y, unnest([n_a, n_b]) AS nx, unnest([n_b, n_a]) AS ny, js FROM who_pairs)
    WHERE split_part(x, '|', 1) <> split_part(y, '|', 1)""")
def ranked_similarity(spark, sf_dir):
    return A.ranked_similarity(counts(spark, sf_dir)).withColumn("js", r4("js")).orderBy(
        "slice", "t_a", "code_a", "js", "t_b", "code_b")


NEAREST = 5


@registered("k19_nearest_similarity", f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY slice, t_a, code_a ORDER BY js, t_b, code_b) AS rank,
             code_a = code_b AS same_code FROM (
        SELECT slice, split_part(x, '|', 1) AS t_a, split_part(x, '|', 2) AS code_a, split_part(y, '|', 1) AS t_b,
               split_part(y, '|', 2) AS code_b, CAST(nx AS BIGINT) AS n_a, CAST(ny AS BIGINT) AS n_b, round(js, 4) AS js
        FROM (SELECT slice, unnest([a, b]) AS x, unnest([b, a]) AS y, unnest([n_a, n_b]) AS nx, unnest([n_b, n_a]) AS ny, js FROM who_pairs)
        WHERE split_part(x, '|', 1) <> split_part(y, '|', 1)))
    WHERE rank <= {NEAREST}""")
def nearest_similarity(spark, sf_dir):
    """The most similar entries of the ranking, found by bounds instead of all pairs."""
    return A.nearest_similar(counts(spark, sf_dir), NEAREST).withColumns(
        {"js": r4("js"), "rank": F.col("rank").cast("long")})


_TEST_COLUMNS = ["slice", "code", "comparison", "a", "b", "chi2", "p_value", "js", "n_a", "n_b"]
for _name, _source in (("all_tests", "between_tests"), ("linear_tests", "rater_rest_tests")):
    oracle.add_view(_name, f"""
    SELECT slice, code, 'between_therapists' AS comparison, a, b, chi2, p_value, js, n_a, n_b FROM {_source}
    UNION ALL SELECT slice, code, 'within_T' || rater, a, b, chi2, p_value, js, n_a, n_b FROM rest_tests""")


def _all_tests(spark, sf_dir, between: DataFrame) -> DataFrame:
    between = _tests(between, "slice", "code").withColumn("comparison", F.lit("between_therapists"))
    within = _tests(_within(spark, sf_dir), "slice", "code", "rater").withColumn(
        "comparison", F.concat(F.lit("within_T"), "rater"))
    return between.select(*_TEST_COLUMNS).unionByName(within.select(*_TEST_COLUMNS))


def _summary_of_tests_sql(tests: str) -> str:
    return f"""
    SELECT slice, comparison, count(*) AS n_tests, count(*) FILTER (WHERE p_value < 0.05) AS n_significant,
           round(max(js), 6) AS max_js FROM {tests} GROUP BY ALL"""


def _summary_of_tests(tests: DataFrame) -> DataFrame:
    return tests.groupBy("slice", "comparison").agg(
        F.count("*").alias("n_tests"), F.count_if(F.col("p_value") < 0.05).alias("n_significant"),
        r6(F.max("js")).alias("max_js"))


def _top_sql(tests: str) -> str:
    return f"""
    SELECT * FROM (SELECT *, p_value < 0.05 AS significant_p05,
             row_number() OVER (ORDER BY js DESC, slice, code, comparison, a, b) AS rank
      FROM {tests} WHERE js IS NOT NULL) WHERE rank <= 10"""


def _top(tests: DataFrame) -> DataFrame:
    order = [F.col("js").desc(), "slice", "code", "comparison", "a", "b"]
    top = tests.filter(F.col("js").isNotNull()).orderBy(*order).limit(10)
    return top.withColumns({
        "significant_p05": F.col("p_value") < 0.05,
        "rank": F.row_number().over(Window.orderBy(*order)).cast("long"),
    })


@registered("k20_test_summary", _summary_of_tests_sql("all_tests"))
def test_summary(spark, sf_dir):
    """How many comparisons of each kind are significant."""
    return _summary_of_tests(_all_tests(spark, sf_dir, _between(spark, sf_dir)))


@registered("k20_top_divergent", _top_sql("all_tests"))
def top_divergent(spark, sf_dir):
    """The ten most divergent comparisons between and within raters."""
    return _top(_all_tests(spark, sf_dir, _between(spark, sf_dir)))


@registered("k20_summary_against_others", _summary_of_tests_sql("linear_tests"))
def tests_against_others(spark, sf_dir):
    """K20 in linear form: each rater against the other raters, each session against the rater's others."""
    return _summary_of_tests(_all_tests(spark, sf_dir, _against_others(spark, sf_dir)))


@registered("k20_top_against_others", _top_sql("linear_tests"))
def top_against_others(spark, sf_dir):
    """The ten most divergent of the comparisons in linear form."""
    return _top(_all_tests(spark, sf_dir, _against_others(spark, sf_dir)))
