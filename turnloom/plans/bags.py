"""Queries over n-grams and bag-of-words tables (inventory E, with C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import blocks as B
from turnloom.operators import ngrams as N
from turnloom.operators import pairs as P
from turnloom.operators.ordered import Ordering
from turnloom.plans import oracle
from turnloom.plans.registry import registered
from turnloom.plans.tables import SIZES, plain_groups, tables

FAMILY = ("level", "n")
# Pairwise tables compare the levels whose groups are a fixed set of names.
NAMED_LEVELS = ("importance", "therapists", "patient_codes", "therapist_codes")
_NAMED = ", ".join(f"'{name}'" for name in NAMED_LEVELS)


def r6(column):
    return F.round(column, 6)


@registered("e01_sequence_ngrams", """
    SELECT cls, n, ngram, count(*) AS cnt FROM grams GROUP BY ALL""")
def sequence_ngrams(spark, sf_dir):
    """n-grams of compressed sequences, rendered with abbreviations."""
    t = tables(spark, sf_dir)
    found = N.ngrams(t.classes(), t.order.keyed("source_file", "cls"), (2, 3, 4, 5))
    return N.count_ngrams(found, "cls")


oracle.add_view("bucket_rows", f"""
    SELECT s.source_file, s.cls, s.seq, s.pos, s.label || CASE
             WHEN h.group_end - h.group_start + 1 <= CASE WHEN h.da_group = 'statements' THEN 2 ELSE 1 END THEN '_S'
             WHEN h.group_end - h.group_start + 1 <= CASE WHEN h.da_group = 'statements' THEN 8 ELSE 3 END THEN '_M' ELSE '_L' END AS label
    FROM seqs s JOIN hub h ON s.source_file = h.source_file AND s.pos = h.pos""")
oracle.add_view("bucket_grams", oracle._grams("bucket_rows", "source_file, cls, seq", (2, 3), "cls"))


@registered("e01_bucketed_ngrams", "SELECT cls, n, ngram, count(*) AS cnt FROM bucket_grams GROUP BY ALL")
def bucketed_ngrams(spark, sf_dir):
    """n-grams of labels that carry the length class of their run."""
    t = tables(spark, sf_dir)
    rows = B.compressed_classes(
        t.hub(), ("patient", "therapist", "neither", "transcript"), "groups", bucketed=True)
    return N.count_ngrams(N.ngrams(rows, t.order.keyed("source_file", "cls"), (2, 3)), "cls")


oracle.add_view("raw_rows", """
    SELECT source_file, cls, seq, pos, replace(replace(replace(replace(replace(replace(proc_da, '-Question', '-Q'),
             '-answers', '-A'), 'Statement-', 'ST-'), 'Acknowledge-', 'Ack-'), 'Conventional-', 'Conv-'), 'Collaborative-', 'Collab-') AS label
    FROM (SELECT *, 'patient' AS cls, patient_start AS seq FROM hub UNION ALL SELECT *, 'therapist', therapist_start FROM hub
          UNION ALL SELECT *, 'neither', neither_start FROM hub UNION ALL SELECT *, 'transcript', 0 FROM hub)
    WHERE seq IS NOT NULL AND pos = greatest(label_start, seq)""")
oracle.add_view("raw_grams", oracle._grams("raw_rows", "source_file, cls, seq", (2, 3, 4, 5), "cls"))


@registered("e01_raw_ngrams", "SELECT cls, n, ngram, count(*) AS cnt FROM raw_grams GROUP BY ALL")
def raw_ngrams(spark, sf_dir):
    """n-grams of the labels themselves instead of their groups."""
    t = tables(spark, sf_dir)
    return N.count_ngrams(N.ngrams(t.classes("raw"), t.order.keyed("source_file", "cls"), (2, 3, 4, 5)), "cls")


oracle.add_view("plain_rows", """
    SELECT source_file, patient_start AS seq, pos, da_group AS label FROM hub WHERE patient_start IS NOT NULL""")
oracle.add_view("plain_grams", oracle._grams(
    "plain_rows", "source_file, seq", (1, 2, 3), "source_file, seq"))


@registered("e02_plain_ngrams", """
    SELECT n, ngram, count(*) AS cnt FROM plain_grams GROUP BY ALL""")
def plain_ngrams(spark, sf_dir):
    """n-grams of block sequences without run-length compression."""
    t = tables(spark, sf_dir)
    rows = B.sequence_rows(t.hub(), "patient").withColumn("label", F.col("da_group"))
    return N.count_ngrams(N.ngrams(rows, t.order, (1, 2, 3)))


def _coded(spark, sf_dir, target="patient", sizes=(2, 3)):
    """Counts of compressed block n-grams per code, NA included."""
    t = tables(spark, sf_dir)

    def build():
        rows = B.compress_runs(B.sequence_rows(t.hub(), target), "groups").withColumn(
            "label", L.abbreviate(F.col("da_group"), "groups"))
        per_block = N.count_ngrams(N.ngrams(rows, t.order, sizes), "source_file", "seq")
        return (
            N.spread_over_codes(per_block, t.block_codes(target))
            .groupBy("code", "n", "ngram").agg(F.sum("cnt").alias("cnt"))
        )

    return t.once(f"{target}_code_ngrams_{'_'.join(map(str, sizes))}", build)


def coded(spark, sf_dir) -> DataFrame:
    """`_coded` of both sides, with the side as `target`."""
    parts = [_coded(spark, sf_dir, target).withColumn("target", F.lit(target)) for target in B.TARGETS]
    return parts[0].unionByName(parts[1])


oracle.add_view("target_codes", """
    SELECT 'patient' AS target, * FROM patient_codes UNION ALL SELECT 'therapist', * FROM therapist_codes""")
oracle.add_view("coded_grams", """
    SELECT target, code, n, ngram, count(*) AS cnt FROM grams g JOIN target_codes c
      ON g.source_file = c.source_file AND g.seq = c.block_start AND g.cls = c.target
    WHERE n <= 3 GROUP BY ALL""")
oracle.add_view("top_coded", """
    SELECT target, n, ngram, pooled, rank FROM (
      SELECT target, n, ngram, CAST(sum(cnt) AS BIGINT) AS pooled,
             row_number() OVER (PARTITION BY target, n ORDER BY sum(cnt) DESC, ngram) AS rank
      FROM coded_grams GROUP BY target, n, ngram) WHERE rank <= 15""")


@registered("e03_code_ngrams", "SELECT * FROM coded_grams")
def code_ngrams(spark, sf_dir):
    return coded(spark, sf_dir)


@registered("e04_top_patterns", """
    SELECT target, t.rank, n, ngram, t.pooled, c.code, c.cnt FROM top_coded t JOIN coded_grams c USING (target, n, ngram)""")
def top_patterns(spark, sf_dir):
    """Top 15 patterns of each side by pooled count, with their count in every code."""
    counts = coded(spark, sf_dir)
    top = N.top_patterns(counts, 15, "target", "n")
    return counts.join(F.broadcast(top), ["target", "n", "ngram"]).select(
        "target", F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n"),
        "ngram", "pooled", "code", "cnt",
    )


@registered("e05_pattern_shares", """
    SELECT target, code, n, ngram, cnt, round(cnt / sum(cnt) OVER (PARTITION BY target, code, n), 6) AS share
    FROM coded_grams SEMI JOIN top_coded USING (target, n, ngram)""")
def pattern_shares(spark, sf_dir):
    counts = coded(spark, sf_dir)
    top = N.top_patterns(counts, 15, "target", "n")
    return N.pattern_shares(counts, top, ["target", "n"], ["target", "code", "n"]).select(
        "target", "code", "n", "ngram", "cnt", r6("share").alias("share"))


oracle.add_view("region_rows", " UNION ALL ".join(f"""
    SELECT '{target}' AS target, source_file, block_start, region, pos, seq, {oracle.short('da_group')} AS label FROM (
      SELECT *, min(pos) OVER (PARTITION BY source_file, block_start, region) AS seq
      FROM ({oracle.context(target, 15)})) WHERE pos = greatest(group_start, seq)""" for target in B.TARGETS))
oracle.add_view("region_grams", oracle._grams(
    "region_rows", "target, source_file, block_start, region", (2,), "target, source_file, block_start, region"))


@registered("e06_context_profile", """
    WITH counted AS (
      SELECT target, code, region, ngram, count(*) AS cnt FROM region_grams JOIN target_codes
      USING (target, source_file, block_start) GROUP BY ALL),
    top AS (SELECT target, ngram FROM counted WHERE region = 'core' GROUP BY target, ngram
            QUALIFY row_number() OVER (PARTITION BY target ORDER BY sum(cnt) DESC, ngram) <= 10)
    SELECT target, code, region, ngram, cnt, round(cnt / sum(cnt) OVER (PARTITION BY target, code, region), 6) AS share
    FROM counted SEMI JOIN top USING (target, ngram)""")
def context_profile(spark, sf_dir):
    """Bigrams before, in and after blocks per code, over each side's ten top block patterns."""
    t = tables(spark, sf_dir)
    parts = []
    for target in B.TARGETS:
        rows = B.context_rows(t.hub(), t.order, target).withColumns(
            {"seq": F.col("region_start"), "seq_end": F.lit(None).cast("long"),
             "label": L.abbreviate(F.col("da_group"), "groups")})
        per_block = N.count_ngrams(
            N.ngrams(B.compress_runs(rows, "groups"),
                     t.order.keyed("source_file", "block_start", "region"), (2,)),
            "source_file", "block_start", "region",
        )
        parts.append(
            per_block.join(t.block_codes(target), ["source_file", "block_start"])
            .groupBy(F.lit(target).alias("target"), "code", "region", "n", "ngram").agg(F.sum("cnt").alias("cnt")))
    counts = parts[0].unionByName(parts[1])
    top = N.top_patterns(counts.filter(F.col("region") == "core"), 10, "target", "n")
    return N.pattern_shares(counts, top, ["target", "n"], ["target", "code", "region"]).select(
        "target", "code", "region", "ngram", "cnt", r6("share").alias("share"))


@registered("e07_frequency_matrix", """
    WITH v AS (SELECT level, n, ngram, CAST(sum(cnt) AS BIGINT) AS raw_count_total FROM levels
               WHERE level <> 'transcripts' GROUP BY ALL),
         g AS (SELECT DISTINCT level, n, "group" FROM levels WHERE level <> 'transcripts')
    SELECT v.level, v.n, v.ngram, g."group", v.raw_count_total, coalesce(f.cnt, 0) AS cnt,
           round(coalesce(f.freq, 0), 6) AS freq
    FROM v JOIN g ON v.level = g.level AND v.n = g.n
    LEFT JOIN level_freq f ON f.level = v.level AND f.n = v.n AND f.ngram = v.ngram AND f."group" = g."group" """)
def frequency_matrix(spark, sf_dir):
    """Union vocabulary by groups with zeros (E7), all n in one tall table."""
    counts = tables(spark, sf_dir).ngram_counts().filter(F.col("level") != "transcripts")
    return N.zero_filled(counts, FAMILY).select(
        "level", "n", "ngram", "group", "raw_count_total", "cnt", r6("freq").alias("freq"))


@registered("e09_transcript_summary", """
    WITH g AS (SELECT count(DISTINCT source_file) AS k FROM hub)
    SELECT n, ngram, CAST(sum(cnt) AS BIGINT) AS raw_count_total, round(sum(freq) / max(k), 6) AS mean_freq,
           round(sqrt(greatest(sum(freq * freq) / max(k) - (sum(freq) / max(k)) ** 2, 0)), 6) AS std_freq,
           round(CASE WHEN count(*) < max(k) THEN 0 ELSE min(freq) END, 6) AS min_freq,
           round(max(freq), 6) AS max_freq, count(*) AS n_present
    FROM level_freq, g WHERE level = 'transcripts' GROUP BY n, ngram""")
def transcript_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    counts = t.ngram_counts().filter(F.col("level") == "transcripts")
    n_groups = t.hub().agg(F.countDistinct("source_file").alias("n_groups"))
    per_family = n_groups.withColumn("n", F.explode(F.array(*[F.lit(n) for n in (2, 3, 4, 5)])))
    return N.sequence_summary(counts, per_family, ["n"]).select(
        "n", "ngram", "raw_count_total", r6("mean_freq").alias("mean_freq"),
        r6("std_freq").alias("std_freq"), r6("min_freq").alias("min_freq"),
        r6("max_freq").alias("max_freq"), "n_present",
    )


oracle.add_view("scored", """
    SELECT f.*, f.freq * ln(k.groups / (1 + p.present)) AS tfidf FROM level_freq f
    JOIN (SELECT level, n, count(DISTINCT "group") AS groups FROM levels GROUP BY ALL) k
      ON k.level = f.level AND k.n = f.n
    JOIN (SELECT level, n, ngram, count(*) AS present FROM levels GROUP BY ALL) p
      ON p.level = f.level AND p.n = f.n AND p.ngram = f.ngram""")


@registered("e11_tf_idf", """
    SELECT level, "group", n, ngram, cnt, round(freq, 6) AS freq, round(tfidf, 6) + 0.0 AS tfidf FROM scored""")
def tf_idf(spark, sf_dir):
    return N.tf_idf(tables(spark, sf_dir).ngram_counts(), FAMILY).select(
        "level", "group", "n", "ngram", "cnt", r6("freq").alias("freq"),
        (r6("tfidf") + 0.0).alias("tfidf"))


@registered("e12_group_cosine", f"""
    WITH g AS (SELECT level, n, "group", sum(freq * freq) AS sq FROM level_freq WHERE level IN ({_NAMED}) GROUP BY ALL)
    SELECT x.level, x.n, x."group" AS group_a, y."group" AS group_b,
           round(coalesce(sum(a.freq * b.freq) / sqrt(max(x.sq) * max(y.sq)), 0), 6) AS cosine_similarity
    FROM g x JOIN g y ON x.level = y.level AND x.n = y.n AND x."group" < y."group"
    LEFT JOIN level_freq a ON a.level = x.level AND a.n = x.n AND a."group" = x."group"
    LEFT JOIN level_freq b ON b.level = y.level AND b.n = y.n AND b."group" = y."group" AND b.ngram = a.ngram
    GROUP BY ALL""")
def group_cosine(spark, sf_dir):
    counts = tables(spark, sf_dir).ngram_counts().filter(F.col("level").isin(*NAMED_LEVELS))
    freq = N.with_frequency(counts, *FAMILY, "group")
    return P.cosine(freq, FAMILY, "group", "ngram", "freq").select(
        "level", "n", F.col("a").alias("group_a"), F.col("b").alias("group_b"),
        r6("cosine").alias("cosine_similarity"))


oracle.add_view("js_terms", f"""
    WITH v AS (SELECT level, n, ngram FROM levels WHERE level IN ({_NAMED}) GROUP BY ALL),
         size AS (SELECT level, n, count(*) AS vocab FROM v GROUP BY ALL),
         g AS (SELECT DISTINCT level, n, "group" FROM levels WHERE level IN ({_NAMED}))
    SELECT v.level, v.n, v.ngram, g."group", (coalesce(f.freq, 0) + 1e-9) / (1 + vocab * 1e-9) AS p
    FROM v JOIN g ON v.level = g.level AND v.n = g.n JOIN size s ON s.level = v.level AND s.n = v.n
    LEFT JOIN level_freq f ON f.level = v.level AND f.n = v.n AND f.ngram = v.ngram AND f."group" = g."group" """)


@registered("e13_group_divergence", """
    SELECT level, n, group_a, group_b, round(js, 6) AS js_divergence, round(1 - js, 6) AS js_similarity FROM (
      SELECT a.level, a.n, a."group" AS group_a, b."group" AS group_b,
             greatest(sum(0.5 * a.p * log2(2 * a.p / (a.p + b.p)) + 0.5 * b.p * log2(2 * b.p / (a.p + b.p))), 0) AS js
      FROM js_terms a JOIN js_terms b ON a.level = b.level AND a.n = b.n AND a.ngram = b.ngram
       AND a."group" < b."group" GROUP BY ALL)""")
def group_divergence(spark, sf_dir):
    counts = tables(spark, sf_dir).ngram_counts().filter(F.col("level").isin(*NAMED_LEVELS))
    return P.frequency_divergence(counts, FAMILY, "group", "ngram", "cnt").select(
        "level", "n", F.col("a").alias("group_a"), F.col("b").alias("group_b"),
        r6("js").alias("js_divergence"), r6(1 - F.col("js")).alias("js_similarity"))


oracle.add_view("dominant_grams", """
    WITH v AS (SELECT level, n, ngram FROM levels GROUP BY ALL),
         g AS (SELECT DISTINCT level, n, "group" FROM levels)
    SELECT * FROM (
      SELECT v.level, g."group", v.n, v.ngram, coalesce(s.tfidf, 0) AS tfidf, coalesce(s.freq, 0) AS freq,
             row_number() OVER (PARTITION BY v.level, g."group", v.n ORDER BY coalesce(s.tfidf, 0) DESC, v.ngram) AS rank
      FROM v JOIN g ON v.level = g.level AND v.n = g.n
      LEFT JOIN scored s ON s.level = v.level AND s.n = v.n AND s.ngram = v.ngram AND s."group" = g."group")
    WHERE rank <= 10""")


def _dominant(spark, sf_dir):
    return N.dominant(N.tf_idf(tables(spark, sf_dir).ngram_counts(), FAMILY), FAMILY, 10)


@registered("e14_dominant_ngrams", """
    SELECT level, "group", n, rank, ngram, round(tfidf, 6) + 0.0 AS tfidf, round(freq, 6) AS freq
    FROM dominant_grams""")
def dominant_ngrams(spark, sf_dir):
    return _dominant(spark, sf_dir).select(
        "level", "group", "n", "rank", "ngram", (r6("tfidf") + 0.0).alias("tfidf"),
        r6("freq").alias("freq"))


@registered("e15_heaviest_ngrams", """
    SELECT * FROM (SELECT level, n, ngram, round(sum(freq), 6) AS row_sum,
             row_number() OVER (PARTITION BY level, n ORDER BY round(sum(freq), 9) DESC, ngram) AS rank
      FROM level_freq WHERE level <> 'transcripts' GROUP BY level, n, ngram) WHERE rank <= 40""")
def heaviest_ngrams(spark, sf_dir):
    counts = tables(spark, sf_dir).ngram_counts().filter(F.col("level") != "transcripts")
    freq = N.with_frequency(counts, *FAMILY, "group")
    return N.heaviest(freq, FAMILY, 40).select(
        "level", "n", "ngram", r6("row_sum").alias("row_sum"), "rank")


@registered("e16_level_ngrams", 'SELECT level, "group", n, ngram, cnt FROM levels')
def level_ngrams(spark, sf_dir):
    """The five comparison levels in one table; D13's pooled groups feed it."""
    return tables(spark, sf_dir).ngram_counts()


_WIDE_CONTEXT = 2


def _with_context(target: str) -> str:
    return f"""
      SELECT source_file, '{target}_important' AS grp, block_start, pos, {oracle.short('da_group')} AS label
      FROM ({oracle.context(target, _WIDE_CONTEXT)}) WHERE pos = greatest(group_start, block_start - {_WIDE_CONTEXT}, 0)"""


oracle.add_view("context_elements", f"""
    {_with_context('patient')} UNION ALL {_with_context('therapist')}
    UNION ALL SELECT source_file, 'non_important', run, pos, {oracle.short('da_group')} FROM (
      SELECT *, min(pos) OVER (PARTITION BY source_file, run) AS first FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY source_file ORDER BY pos) AS run FROM (
          SELECT *, max(CASE WHEN either_start IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source_file ORDER BY pos
                   ROWS BETWEEN {_WIDE_CONTEXT} PRECEDING AND {_WIDE_CONTEXT} FOLLOWING) AS claimed FROM hub) WHERE claimed = 0))
    WHERE pos = greatest(group_start, first)""")
oracle.add_view("context_grams", oracle._grams(
    "context_elements", "source_file, grp, block_start", (2, 3), "grp"))


@registered("e16_importance_with_context", """
    SELECT grp AS "group", n, ngram, count(*) AS cnt FROM context_grams GROUP BY ALL""")
def importance_with_context(spark, sf_dir):
    """The importance comparison where a block absorbs the rows around it and the rest loses
    them."""
    t = tables(spark, sf_dir)
    parts = [
        B.compress_runs(B.context_sequences(t.hub(), t.order, target, _WIDE_CONTEXT), "groups").select(
            "source_file", "block_start", "pos", "seq", "da_group", F.lit(f"{target}_important").alias("group"))
        for target in B.TARGETS
    ]
    rest = B.unclaimed(t.hub(), t.order, _WIDE_CONTEXT)
    rest = rest.withColumns({"seq": F.col("free_start"), "seq_end": F.col("free_end")})
    parts.append(B.compress_runs(rest, "groups").select(
        "source_file", F.col("seq").alias("block_start"), "pos", "seq", "da_group",
        F.lit("non_important").alias("group")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn(
        "label", L.abbreviate(F.col("da_group"), "groups"))
    found = N.ngrams(rows, t.order.keyed("source_file", "group", "block_start"), (2, 3))
    return N.count_ngrams(found, "group")


oracle.add_view("group_elements", """
    SELECT 'importance' AS level, CASE cls WHEN 'neither' THEN 'non_important' ELSE cls || '_important' END AS grp,
           source_file, pos, label FROM seqs WHERE cls <> 'transcript'
    UNION ALL SELECT 'transcripts', source_file, source_file, pos, label FROM seqs WHERE cls = 'transcript'
    UNION ALL SELECT 'therapists', 'therapist_' || regexp_extract(source_file, '(.)_with', 1), source_file, pos, label
              FROM seqs WHERE cls = 'transcript'
    UNION ALL SELECT target || '_codes', target || '_' || code, s.source_file, pos, label FROM seqs s
              JOIN target_codes c ON s.source_file = c.source_file AND s.seq = c.block_start AND s.cls = c.target
              WHERE code <> 'NA'
    UNION ALL SELECT unnest(['patient_codes', 'therapist_codes']), 'non_important', source_file, pos, label
              FROM seqs WHERE cls = 'neither'""")
oracle.add_view("joined_elements", """
    SELECT level, grp, row_number() OVER (PARTITION BY level, grp ORDER BY source_file, pos) AS pos, label FROM (
      SELECT *, lag(label) OVER (PARTITION BY level, grp ORDER BY source_file, pos) AS before FROM group_elements)
    WHERE label IS DISTINCT FROM before""")
oracle.add_view("joined_grams", oracle._grams("joined_elements", "level, grp", (2, 3, 4, 5), "level, grp"))


@registered("e16_concatenated_groups", """
    SELECT level, grp AS "group", n, ngram, count(*) AS cnt FROM joined_grams GROUP BY ALL""")
def concatenated_groups(spark, sf_dir):
    """Pooled groups of all five levels read as one long sequence each, so that n-grams also span the joints."""
    t = tables(spark, sf_dir)
    rows = t.classes()
    parts = [rows.select("source_file", "pos", "label", F.inline(plain_groups()))]
    for target in B.TARGETS:
        parts.append(
            rows.filter(F.col("cls") == target)
            .join(t.block_codes(target).filter(F.col("code") != "NA")
                  .select("source_file", F.col("block_start").alias("seq"), "code"), ["source_file", "seq"])
            .select("source_file", "pos", "label", F.lit(f"{target}_codes").alias("level"),
                    F.concat(F.lit(f"{target}_"), F.col("code")).alias("group")))
    joined = N.concatenated(parts[0].unionByName(parts[1]).unionByName(parts[2]), t.order, "level", "group")
    along = Ordering(("level", "group"), "pos")
    return N.count_ngrams(N.ngrams(joined, along, SIZES), "level", "group")


@registered("e17_dominant_preview", """
    SELECT level, "group", rank, ngram, round(tfidf, 6) + 0.0 AS tfidf FROM dominant_grams
    WHERE n = 2 AND rank <= 5""")
def dominant_preview(spark, sf_dir):
    counts = tables(spark, sf_dir).ngram_counts().filter(F.col("n") == 2)
    return N.dominant(N.tf_idf(counts, FAMILY), FAMILY, 5).select(
        "level", "group", "rank", "ngram", (r6("tfidf") + 0.0).alias("tfidf"))
