"""Queries over labels, keys, blocks, context and sequences (inventory C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import blocks as B
from turnloom.operators import features as X
from turnloom.plans import oracle
from turnloom.plans.registry import registered
from turnloom.plans.tables import tables


def joined(column: str, separator: str = ","):
    return F.array_join(column, separator)


@registered("c04_extended_groups", """
    SELECT proc_da, da_group, count(*) AS n_rows FROM hub GROUP BY ALL""")
def extended_groups(spark, sf_dir):
    return (
        tables(spark, sf_dir).hub()
        .groupBy("proc_da", L.extended_group(F.col("proc_da")).alias("da_group"))
        .agg(F.count("*").alias("n_rows"))
    )


@registered("c05_core_groups", f"""
    SELECT proc_da, coalesce({oracle.core('proc_da')}, '-') AS core_group,
           {oracle.core('proc_da', "'other'")} AS core_or_other,
           {oracle.core('proc_da', "'unmapped'")} AS core_or_unmapped, count(*) AS n_rows
    FROM hub GROUP BY ALL""")
def core_groups(spark, sf_dir):
    label = F.col("proc_da")
    return (
        tables(spark, sf_dir).hub()
        .groupBy("proc_da")
        .agg(F.count("*").alias("n_rows"))
        .select(
            "proc_da",
            F.coalesce(L.core_group(label), F.lit("-")).alias("core_group"),
            L.core_group(label, "other").alias("core_or_other"),
            L.core_group(label, "unmapped").alias("core_or_unmapped"),
            "n_rows",
        )
    )


@registered("c06_granularity", """
    SELECT 'groups' AS granularity, da_group AS label, count(*) AS n_rows FROM hub GROUP BY ALL
    UNION ALL SELECT 'raw', proc_da, count(*) FROM hub GROUP BY ALL""")
def granularity(spark, sf_dir):
    hub = tables(spark, sf_dir).hub()
    parts = [
        hub.groupBy(F.lit(g).alias("granularity"), L.pick_label(g).alias("label"))
        .agg(F.count("*").alias("n_rows"))
        for g in ("groups", "raw")
    ]
    return parts[0].unionByName(parts[1])


_RAW_SHORT = (
    "replace(replace(replace(replace(replace(replace(proc_da, '-Question', '-Q'), '-answers', '-A'),"
    " 'Statement-', 'ST-'), 'Acknowledge-', 'Ack-'), 'Conventional-', 'Conv-'),"
    " 'Collaborative-', 'Collab-')"
)


def _bucket(length: str, group: str = "da_group") -> str:
    return (
        f"CASE WHEN {length} <= CASE WHEN {group} = 'statements' THEN 2 ELSE 1 END THEN 'short'"
        f" WHEN {length} <= CASE WHEN {group} = 'statements' THEN 8 ELSE 3 END THEN 'medium'"
        " ELSE 'long' END"
    )


@registered("c07_abbreviations", f"""
    SELECT proc_da, {oracle.short('da_group')} || '_' ||
             CASE {_bucket('group_end - group_start + 1')} WHEN 'short' THEN 'S'
             WHEN 'medium' THEN 'M' ELSE 'L' END AS group_short,
           {_RAW_SHORT} AS raw_short, count(*) AS n_rows
    FROM hub GROUP BY ALL""")
def abbreviations(spark, sf_dir):
    return (
        tables(spark, sf_dir).hub()
        .groupBy(
            "proc_da",
            L.abbreviate(B.row_label("groups", bucketed=True), "groups").alias("group_short"),
            L.abbreviate(F.col("proc_da"), "raw").alias("raw_short"),
        )
        .agg(F.count("*").alias("n_rows"))
    )


@registered("c09_run_length_buckets", f"""
    SELECT da_group, group_end - group_start + 1 AS run_length,
           {_bucket('group_end - group_start + 1')} AS bucket, count(*) AS n_rows
    FROM hub GROUP BY ALL""")
def run_length_buckets(spark, sf_dir):
    start, end = B.run_bounds("groups")
    length = end - start + 1
    return (
        tables(spark, sf_dir).hub()
        .groupBy("da_group", length.alias("run_length"),
                 L.bucket_suffix(F.col("da_group"), length, "groups").alias("bucket"))
        .agg(F.count("*").alias("n_rows"))
    )


@registered("c11_bucketed_labels", f"""
    SELECT source_file, pos, da_group || '_' || {_bucket('group_end - group_start + 1')} AS group_label,
           proc_da || '_' || {_bucket('label_end - label_start + 1')} AS raw_label,
           da_group AS stripped
    FROM hub""")
def bucketed_labels(spark, sf_dir):
    """Run-bucketed label of every row, and the label with the suffix taken off again."""
    group_label = B.row_label("groups", bucketed=True)
    return tables(spark, sf_dir).hub().select(
        "source_file", "pos", group_label.alias("group_label"),
        B.row_label("raw", bucketed=True).alias("raw_label"),
        L.strip_bucket(group_label).alias("stripped"),
    )


@registered("c12_parsed_codes", f"""
    SELECT 'patient' AS target, code, count(*) AS n_rows
    FROM (SELECT unnest({oracle.codes('patient_code')}) AS code FROM hub) GROUP BY ALL
    UNION ALL SELECT 'therapist', code, count(*)
    FROM (SELECT unnest({oracle.codes('therapist_code')}) AS code FROM hub) GROUP BY ALL""")
def parsed_codes(spark, sf_dir):
    """Code cells split, cleaned, defaulted to NA (C12) and exploded."""
    hub = tables(spark, sf_dir).hub()
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), L.parse_codes(F.col(f"{t}_code")).alias("codes"))
        for t in B.TARGETS
    ])
    return (
        hub.select(F.inline(cells))
        .select("target", F.explode("codes").alias("code"))
        .groupBy("target", "code").agg(F.count("*").alias("n_rows"))
    )


_DESCRIBED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CODE_DESCRIPTIONS.items())


@registered("c14_code_descriptions", f"""
    SELECT source_file, pos, string_agg(CASE code {_DESCRIBED} ELSE 'NA' END, ',' ORDER BY i) AS described
    FROM (SELECT source_file, pos, unnest(c) AS code, generate_subscripts(c, 1) AS i
          FROM (SELECT source_file, pos,
                  CASE WHEN therapist THEN {oracle.codes('therapist_code')}
                       ELSE {oracle.codes('patient_code')} END AS c FROM hub)) GROUP BY ALL""")
def code_descriptions(spark, sf_dir):
    """Descriptions of the codes shown for a row: the rater's own where important to them."""
    cell = F.when(B.is_important("therapist"), F.col("therapist_code")).otherwise(F.col("patient_code"))
    described = F.transform(L.parse_codes(cell), L.describe_code)
    return tables(spark, sf_dir).hub().select(
        "source_file", "pos", F.array_join(described, ",").alias("described")
    )


@registered("c15_file_ids", """
    SELECT DISTINCT source_file, regexp_extract(source_file, '(.)_with', 1) AS marker_id,
           regexp_extract(split_part(source_file, '_', 1), 'T([0-9]+)', 1) AS prefix_id,
           regexp_extract(source_file, 'AC([0-9]{2})', 1) AS patient_id
    FROM event_rows WHERE proc_da <> 'I-'""")
def file_ids(spark, sf_dir):
    """The three ids a file name carries."""
    name = F.col("source_file")
    return tables(spark, sf_dir).hub().select("source_file").distinct().select(
        "source_file",
        L.therapist_before_marker(name).alias("marker_id"),
        L.therapist_in_prefix(name).alias("prefix_id"),
        L.patient_in_name(name).alias("patient_id"),
    )


@registered("c18_speakers", """
    SELECT CASE role WHEN 'assistant' THEN 'Therapist' WHEN 'user' THEN 'Patient' ELSE 'system' END AS speaker,
           CASE WHEN role = 'assistant' THEN 'therapist' ELSE 'patient' END AS normalised,
           count(*) AS n_turns
    FROM conversations GROUP BY ALL""")
def speakers(spark, sf_dir):
    from turnloom.plans.bridge import turns

    return (
        turns(spark, sf_dir)
        .groupBy("speaker", L.normalise_speaker(F.col("speaker")).alias("normalised"))
        .agg(F.count("*").alias("n_turns"))
    )


@registered("c19_normalised_time", """
    SELECT source_file, pos, clock AS seconds,
           round(coalesce(CASE WHEN hi = lo THEN 0.5 ELSE (clock - lo) / (hi - lo) END, 0.5), 6) AS ts_norm
    FROM (SELECT *, min(clock) OVER (PARTITION BY source_file) AS lo,
                 max(clock) OVER (PARTITION BY source_file) AS hi
          FROM (SELECT source_file, pos, CAST(split_part(timestamp, ':', 1) AS DOUBLE) * 3600
                  + CAST(split_part(timestamp, ':', 2) AS DOUBLE) * 60
                  + CAST(split_part(timestamp, ':', 3) AS DOUBLE) AS clock FROM hub))""")
def normalised_time(spark, sf_dir):
    t = tables(spark, sf_dir)
    clocked = t.hub().select(
        "source_file", "pos", L.clock_seconds(F.col("timestamp")).alias("seconds")
    )
    return X.normalise_time(clocked, t.order, "seconds").select(
        "source_file", "pos", "seconds", F.round("ts_norm", 6).alias("ts_norm")
    )


def _blocks(target: str):
    def query(spark, sf_dir):
        return B.block_table(tables(spark, sf_dir).hub(), target).select(
            "source_file", "block_start", "block_end", "n_rows", joined("codes").alias("codes")
        )

    return query


for _target in B.TARGETS:
    registered(f"d01_{_target}_blocks", f"""
        SELECT b.*, c.codes FROM {_target}_blocks b
        JOIN (SELECT source_file, block_start, string_agg(code, ',' ORDER BY code_index) AS codes
              FROM {_target}_codes GROUP BY ALL) c USING (source_file, block_start)""")(_blocks(_target))


def _both(spark, sf_dir, query):
    """`query(tables, target)` for both sides, with the side as a column."""
    t = tables(spark, sf_dir)
    parts = [query(t, target).withColumn("target", F.lit(target)) for target in B.TARGETS]
    return parts[0].unionByName(parts[1])


def _both_sql(query) -> str:
    return " UNION ALL ".join(f"SELECT '{target}' AS target, * FROM ({query(target)})" for target in B.TARGETS)


@registered("d02_context_regions", _both_sql(lambda target: f"""
    SELECT source_file, block_start, region, count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos
    FROM ({oracle.context(target, 15)}) GROUP BY ALL"""))
def context_regions(spark, sf_dir):
    return _both(spark, sf_dir, lambda t, target: (
        B.context_rows(t.hub(), t.order, target)
        .groupBy("source_file", "block_start", "region")
        .agg(F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"),
             F.max("pos").alias("last_pos"))))


@registered("d03_block_code_rows", """
    SELECT 'patient' AS target, * FROM patient_codes UNION ALL SELECT 'therapist', * FROM therapist_codes""")
def block_code_rows(spark, sf_dir):
    """One row per (block, code), codes in order of first appearance."""
    t = tables(spark, sf_dir)
    parts = [
        t.block_codes(target).select(
            F.lit(target).alias("target"), "source_file", "block_start", "code",
            F.col("code_index").cast("long").alias("code_index"),
        )
        for target in B.TARGETS
    ]
    return parts[0].unionByName(parts[1])


@registered("d04_window_codes", _both_sql(lambda target: f"""
    SELECT b.source_file, b.block_start, coalesce(c.codes, 'NA') AS codes FROM {target}_blocks b LEFT JOIN (
      SELECT source_file, block_start, string_agg(code, ',' ORDER BY seen) AS codes FROM (
        SELECT source_file, {target}_start AS block_start, code, min(pos * 100 + i) AS seen
        FROM (SELECT source_file, {target}_start, pos, unnest({oracle.codes(target + '_code')}) AS code,
                     generate_subscripts({oracle.codes(target + '_code')}, 1) AS i
              FROM hub WHERE {target}_start IS NOT NULL AND {target}_code IS NOT NULL)
        GROUP BY ALL) GROUP BY ALL) c USING (source_file, block_start)"""))
def window_codes(spark, sf_dir):
    """Block codes where empty cells are ignored before parsing."""
    return _both(spark, sf_dir, lambda t, target: B.block_table(t.hub(), target, skip_null=True).select(
        "source_file", "block_start", joined("codes").alias("codes")))


def _unclaimed_sql(context: int) -> str:
    return f"""
    SELECT source_file, pos, max(CASE WHEN opens THEN pos END) OVER (PARTITION BY source_file ORDER BY pos)
             AS free_start
    FROM (SELECT *, pos - 1 IS DISTINCT FROM lag(pos) OVER (PARTITION BY source_file ORDER BY pos) AS opens
          FROM (SELECT source_file, pos, max(CASE WHEN is_either THEN 1 ELSE 0 END) OVER (
                  PARTITION BY source_file ORDER BY pos ROWS BETWEEN {context} PRECEDING
                  AND {context} FOLLOWING) AS claimed
                FROM (SELECT *, either_start IS NOT NULL AS is_either FROM hub)) WHERE claimed = 0)"""


@registered("d06_unimportant_sequences", _unclaimed_sql(0))
def unimportant_sequences(spark, sf_dir):
    return B.sequence_rows(tables(spark, sf_dir).hub(), "neither").select(
        "source_file", "pos", F.col("seq").alias("free_start")
    )


@registered("d06_unclaimed_with_context", _unclaimed_sql(2))
def unclaimed_with_context(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.unclaimed(t.hub(), t.order, 2).select("source_file", "pos", "free_start")


@registered("d07_blocks_by_slice", f"""
    WITH c AS ({oracle.context('patient', 3)})
    SELECT source_file, block_start, 'all' AS slice, pos, da_group AS label FROM c
    UNION ALL SELECT source_file, block_start,
      CASE WHEN speaker = 'Therapist' THEN 'therapist_spkr' ELSE 'patient_spkr' END, pos, da_group FROM c""")
def blocks_by_slice(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.with_slices(B.context_rows(t.hub(), t.order, "patient", 3)).select(
        "source_file", "block_start", "slice", "pos", F.col("da_group").alias("label")
    )


@registered("d08_rest_windows", """
    SELECT 'whole' AS windowing, rater, source_file, patient_rest_start AS seq, pos, da_group AS label
    FROM hub WHERE patient_rest_start IS NOT NULL
    UNION ALL
    SELECT 'four', rater, source_file, patient_rest_start + chunk * 4, pos, da_group
    FROM (SELECT *, (pos - patient_rest_start) // 4 AS chunk,
                 count(*) OVER (PARTITION BY source_file, patient_rest_start, (pos - patient_rest_start) // 4) AS size
          FROM hub WHERE patient_rest_start IS NOT NULL) WHERE size = 4""")
def rest_windows(spark, sf_dir):
    hub = tables(spark, sf_dir).hub()
    parts = [
        B.rest_windows(hub, "patient", size).select(
            F.lit(name).alias("windowing"),
            L.therapist_in_prefix(F.col("source_file")).alias("rater"),
            "source_file", "seq", "pos", F.col("da_group").alias("label"),
        )
        for name, size in (("whole", None), ("four", 4))
    ]
    return parts[0].unionByName(parts[1])


@registered("d09_rest_windows_by_speaker", """
    SELECT source_file, patient_rest_start AS seq, slice,
           count(*) FILTER (WHERE slice = 'therapist_spkr' AND speaker = 'Therapist'
                            OR slice = 'patient_spkr' AND speaker <> 'Therapist') AS n_labels
    FROM hub, (VALUES ('therapist_spkr'), ('patient_spkr')) AS v(slice)
    WHERE patient_rest_start IS NOT NULL GROUP BY ALL""")
def rest_windows_by_speaker(spark, sf_dir):
    """Every run counts once per speaker, even where that speaker says nothing in it."""
    spoken = F.concat(L.normalise_speaker(F.col("speaker")), F.lit("_spkr"))
    return (
        B.rest_windows(tables(spark, sf_dir).hub(), "patient")
        .withColumn("slice", F.explode(F.array(F.lit("therapist_spkr"), F.lit("patient_spkr"))))
        .groupBy("source_file", "seq", "slice")
        .agg(F.count_if(spoken == F.col("slice")).alias("n_labels"))
    )


@registered("d10_clamped_chunks", """
    WITH b AS (SELECT source_file, either_start AS block_start, max(either_end) AS block_end
               FROM hub WHERE either_start IS NOT NULL GROUP BY ALL),
         n AS (SELECT source_file, max(pos) AS last_pos FROM hub GROUP BY ALL),
         e AS (SELECT b.*, last_pos,
                 coalesce(lag(block_end) OVER (PARTITION BY source_file ORDER BY block_start), -1) AS prev_end,
                 coalesce(lead(block_start) OVER (PARTITION BY source_file ORDER BY block_start),
                          last_pos + 1) AS next_start
               FROM b JOIN n USING (source_file))
    SELECT source_file, block_start, block_end, greatest(prev_end + 1, block_start - 15) AS context_start,
           least(next_start - 1, block_end + 15) AS context_end FROM e""")
def clamped_chunks(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.clamped_chunks(t.hub(), t.order)


@registered("d12_sequence_classes", """
    SELECT cls, label, count(*) AS n_runs, CAST(sum(run_length) AS BIGINT) AS n_rows,
           count(DISTINCT source_file || ':' || seq) AS n_sequences
    FROM seqs GROUP BY ALL""")
def sequence_classes(spark, sf_dir):
    """Pooled patient / therapist / neither / whole-transcript sequences."""
    rows = tables(spark, sf_dir).classes()
    return rows.groupBy("cls", "label").agg(
        F.count("*").alias("n_runs"), F.sum("run_length").alias("n_rows"),
        F.countDistinct("source_file", "seq").alias("n_sequences"),
    )


@registered("d13_pooled_groups", """
    SELECT 'therapists' AS level, 'therapist_' || marker_id AS "group", count(*) AS n_rows FROM hub GROUP BY ALL
    UNION ALL SELECT 'patient_codes', 'patient_' || code, count(*) FROM hub h JOIN patient_codes c
      ON h.source_file = c.source_file AND h.patient_start = c.block_start WHERE code <> 'NA' GROUP BY ALL
    UNION ALL SELECT 'therapist_codes', 'therapist_' || code, count(*) FROM hub h JOIN therapist_codes c
      ON h.source_file = c.source_file AND h.therapist_start = c.block_start WHERE code <> 'NA' GROUP BY ALL
    UNION ALL SELECT t || '_codes', 'non_important', count(*) FROM hub, (VALUES ('patient'), ('therapist')) v(t)
      WHERE neither_start IS NOT NULL GROUP BY ALL""")
def pooled_groups(spark, sf_dir):
    """Row counts of the pooled comparison groups: therapists, and codes against the rest.
    Rows are counted per block before the block meets its codes."""
    t = tables(spark, sf_dir)
    hub = t.hub()
    parts = [
        hub.groupBy(
            F.lit("therapists").alias("level"),
            F.concat(F.lit("therapist_"), L.therapist_before_marker(F.col("source_file")))
            .alias("group"),
        ).agg(F.count("*").alias("n_rows"))
    ]
    for target in B.TARGETS:
        parts.append(
            B.blocks(hub, target)
            .join(t.block_codes(target).filter(F.col("code") != "NA"), ["source_file", "block_start"])
            .groupBy(F.lit(f"{target}_codes").alias("level"),
                     F.concat(F.lit(f"{target}_"), F.col("code")).alias("group"))
            .agg(F.sum("n_rows").alias("n_rows"))
        )
        parts.append(
            B.sequence_rows(hub, "neither")
            .groupBy(F.lit(f"{target}_codes").alias("level"), F.lit("non_important").alias("group"))
            .agg(F.count("*").alias("n_rows"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@registered("d14_compressed_runs", """
    SELECT cls, source_file, seq, pos, label, run_length FROM seqs WHERE cls <> 'transcript'""")
def compressed_runs(spark, sf_dir):
    return B.compressed_classes(
        tables(spark, sf_dir).hub(), ("patient", "therapist", "neither"), "groups",
    ).select("cls", "source_file", "seq", "pos", "label", "run_length")


@registered("d15_mean_run_lengths", _both_sql(lambda target: f"""
    SELECT code, da_group AS label, count(*) AS n_runs, round(avg(run_length), 6) AS mean_run_length
    FROM seqs s JOIN {target}_codes c ON s.source_file = c.source_file AND s.seq = c.block_start
    WHERE cls = '{target}' GROUP BY ALL"""))
def mean_run_lengths(spark, sf_dir):
    def query(t, target):
        per_block = (
            B.compress_runs(B.sequence_rows(t.hub(), target), "groups")
            .groupBy("source_file", F.col("seq").alias("block_start"), F.col("da_group").alias("label"))
            .agg(F.count("*").alias("n_runs"), F.sum("run_length").alias("n_rows"))
        )
        return (
            per_block.join(t.block_codes(target), ["source_file", "block_start"])
            .groupBy("code", "label")
            .agg(F.sum("n_runs").alias("n_runs"),
                 F.round(F.sum("n_rows") / F.sum("n_runs"), 6).alias("mean_run_length"))
        )

    return _both(spark, sf_dir, query)


@registered("d16_run_bucket_counts", _both_sql(lambda target: f"""
    SELECT label, CAST(count(*) FILTER (WHERE bucket = 'short') AS BIGINT) AS short,
           CAST(count(*) FILTER (WHERE bucket = 'medium') AS BIGINT) AS medium,
           CAST(count(*) FILTER (WHERE bucket = 'long') AS BIGINT) AS long
    FROM (SELECT da_group AS label, {_bucket('group_end - group_start + 1')} AS bucket
          FROM hub WHERE {target}_start IS NOT NULL AND pos = greatest(group_start, {target}_start))
    GROUP BY ALL"""))
def run_bucket_counts(spark, sf_dir):
    return _both(spark, sf_dir, lambda t, target: (
        B.run_bucket_counts(B.sequence_rows(t.hub(), target), "groups")
        .groupBy("label").pivot("bucket", ["short", "medium", "long"])
        .agg(F.sum("n_runs")).fillna(0)))
