"""Queries over sources, sinks, word preparation and collapse (inventory A, B, C1-C3)."""

from __future__ import annotations

import math
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from turnloom.functions import labels as L
from turnloom.operators import agreement as A
from turnloom.operators import words as W
from turnloom.plans import bridge, oracle
from turnloom.plans.registry import registered
from turnloom.plans.tables import tables
from turnloom.schemas import TURN
from turnloom.session import shared_folder, write_table
from turnloom.sources import readers, writers
from turnloom.streaming import ingest


def folder(spark, name: str) -> str:
    """A fresh folder under the shared one."""
    return os.path.join(shared_folder(spark), "turnloom", f"{name}-{uuid.uuid4().hex}")


# --- words -----------------------------------------------------------------------------

oracle.add_view("turn_rows", """
    SELECT 'conv_' || conv_id AS source_file, turn, CASE role WHEN 'assistant' THEN 'Therapist'
             WHEN 'user' THEN 'Patient' ELSE 'system' END AS speaker,
           regexp_replace(text, '[—–-]', ' ', 'g') AS spoken_text
    FROM conversations WHERE regexp_matches(text, '\\S') AND text <> 'â€”'""")
oracle.add_view("word_rows", """
    SELECT source_file, turn, speaker, word, replace(replace(regexp_replace(word, '[^\\x00-\\x7F]+', '', 'g'), ' ', ''), chr(10), '') AS scrubbed,
           row_number() OVER (PARTITION BY source_file ORDER BY turn, i) - 1 AS pos, i - 1 AS word_pos
    FROM (SELECT source_file, turn, speaker, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
      SELECT *, list_filter(string_split(spoken_text, ' '), lambda x: regexp_matches(x, '\\S')) AS w FROM turn_rows))""")
oracle.add_view("packed", """
    WITH RECURSIVE sized AS (SELECT source_file, pos, length(scrubbed) AS n FROM word_rows),
    r AS (SELECT source_file, pos, CASE WHEN n + 1 > 512 THEN n ELSE n + 1 END AS open, CASE WHEN n + 1 > 512 THEN 1 ELSE 0 END AS win
          FROM sized WHERE pos = 0
          UNION ALL SELECT s.source_file, s.pos, CASE WHEN open + n + 1 > 512 THEN n ELSE open + n + 1 END,
                    CASE WHEN open + n + 1 > 512 THEN win + 1 ELSE win END
          FROM r JOIN sized s ON s.source_file = r.source_file AND s.pos = r.pos + 1)
    SELECT source_file, pos, win FROM r""")
oracle.add_view("window_rows", """
    SELECT source_file, win, string_agg(scrubbed, ' ' ORDER BY pos) AS text, count(*) AS n_words
    FROM packed JOIN word_rows USING (source_file, pos) GROUP BY ALL HAVING regexp_matches(text, '\\S')""")


@registered("b03_clean_turns", "SELECT source_file, turn, speaker, spoken_text FROM turn_rows")
def clean_turns(spark, sf_dir):
    """Blank and sentinel turns dropped (B1, B2), dashes to spaces."""
    return W.clean_turns(bridge.turns(spark, sf_dir)).select("source_file", "turn", "speaker", "spoken_text")


@registered("b04_words", """
    SELECT source_file, turn, speaker, pos, word_pos, word AS spoken_text, scrubbed FROM word_rows""")
def words(spark, sf_dir):
    """Turn words in order (B4), scrubbed."""
    return tables(spark, sf_dir).words().select(
        "source_file", "turn", "speaker", "pos", F.col("word_pos").cast("long").alias("word_pos"),
        "spoken_text", "scrubbed")


def _windows(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.once("windows", lambda: W.window_texts(W.assign_windows(t.words(), t.word_order())))


@registered("b08_packed_windows", 'SELECT source_file, win AS "window", n_words, text FROM window_rows')
def packed_windows(spark, sf_dir):
    """Greedy windows of 512 characters (B8), blank ones dropped."""
    return _windows(spark, sf_dir).select(
        "source_file", "window", F.size("words").cast("long").alias("n_words"), "text")


@registered("b09_one_window", """
    SELECT source_file, string_agg(scrubbed, ' ' ORDER BY pos) AS text FROM word_rows GROUP BY ALL""")
def one_window(spark, sf_dir):
    pieces = W.one_window(tables(spark, sf_dir).words())
    return W.whole(pieces, ["source_file"], "text").select("source_file", "text")


@registered("b11_merged_turns", """
    SELECT source_file, min(pos) AS first_pos, filled AS speaker, count(*) AS n_words,
           string_agg(word, ' ' ORDER BY pos) AS spoken_text FROM (
      SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY pos) AS run FROM (
        SELECT *, filled IS DISTINCT FROM lag(filled) OVER (PARTITION BY source_file ORDER BY pos) AS changed FROM (
          SELECT *, last_value(CASE WHEN speaker <> 'system' THEN speaker END IGNORE NULLS)
                   OVER (PARTITION BY source_file ORDER BY pos) AS filled FROM word_rows))) GROUP BY source_file, run, filled""")
def merged_turns(spark, sf_dir):
    """Words back to turns; words without a speaker continue the turn before them."""
    t = tables(spark, sf_dir)
    unknown = t.words().withColumn("speaker", F.when(F.col("speaker") != "system", F.col("speaker")))
    pieces = W.merge_speaker_turns(unknown, t.word_order())
    return W.whole(pieces, ["source_file", "first_pos"], "spoken_text", F.first("speaker").alias("speaker"),
                   F.sum("n_words").alias("n_words")).select(
        "source_file", "first_pos", "speaker", "n_words", "spoken_text")


ENDINGS = {".": "Statement-non-opinion", ",": "Hedge", "?": "Wh-Question"}


def load_rule_scorer():
    """Stands in for a model: the last character of a word decides its label."""

    def score(texts):
        return [
            [{"word": f"Ġ{w}", "entity": ENDINGS.get(w[-1], L.INSIDE_LABEL), "score": len(w) / 100.0}
             for w in text.split(" ") if w]
            for text in texts
        ]

    return score


oracle.add_view("scored_words", """
    SELECT *, CASE WHEN scrubbed = '' THEN NULL ELSE CASE right(scrubbed, 1) WHEN '.' THEN 'Statement-non-opinion' WHEN ',' THEN 'Hedge'
             WHEN '?' THEN 'Wh-Question' ELSE 'I-' END END AS pred_da,
           CASE WHEN scrubbed <> '' THEN length(scrubbed) / 100.0::DOUBLE END AS raw_score
    FROM word_rows""")


def _scored(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.once("scored_words", lambda: W.attach_scores(
        t.words(), W.score_words(_windows(spark, sf_dir), load_rule_scorer)))


@registered("b13_scored_words", """
    SELECT source_file, pos, scrubbed AS words_prediction, pred_da, round(raw_score, 6) AS raw_score FROM scored_words
    WHERE pred_da IS NOT NULL
    UNION ALL SELECT source_file, pos, NULL, NULL, NULL FROM scored_words WHERE pred_da IS NULL""")
def scored_words(spark, sf_dir):
    """Windows scored and aligned to words, joined by position."""
    return _scored(spark, sf_dir).select(
        "source_file", "pos", "words_prediction", "pred_da", F.round("raw_score", 6).alias("raw_score"))


def _annotated_sql(source: str) -> str:
    w = "PARTITION BY source_file ORDER BY pos"
    return f"""
      SELECT *, CASE WHEN pred_da IS NOT NULL THEN sum(CASE WHEN pred_da IS NULL THEN 1
                 WHEN pred_da <> before AND before <> 'I-' THEN 1 ELSE 0 END) OVER ({w}) END AS da_number,
             CASE WHEN pred_da IS NOT NULL THEN coalesce(first_value(CASE WHEN pred_da <> 'I-' THEN pred_da END IGNORE NULLS)
                 OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), pred_da) END AS proc,
             CASE WHEN pred_da IS NOT NULL THEN coalesce(first_value(CASE WHEN pred_da <> 'I-' THEN raw_score END IGNORE NULLS)
                 OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), raw_score) END AS score
      FROM (SELECT *, coalesce(last_value(pred_da IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'I-') AS before
            FROM {source})"""


oracle.add_view("event_words", """
    SELECT *, CASE WHEN proc_da <> 'Quotation' THEN proc_da END AS pred_da, length(spoken_text) / 100.0::DOUBLE AS raw_score FROM all_rows""")
oracle.add_view("annotated_events", _annotated_sql("event_words"))
oracle.add_view("annotated_words", _annotated_sql("scored_words"))


def _event_words(spark, sf_dir) -> DataFrame:
    """Event rows read as words: inside labels included, quotations unlabelled."""
    return tables(spark, sf_dir).numbered_events().withColumns({
        "pred_da": F.when(F.col("proc_da") != "Quotation", F.col("proc_da")),
        "raw_score": F.length("spoken_text") / 100.0,
    }).drop("proc_da")


def _annotated(words: DataFrame, order) -> DataFrame:
    return W.back_fill(W.number_segments(words, order), order)


def _annotated_events(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.once("annotated_events", lambda: _annotated(_event_words(spark, sf_dir), t.order))


@registered("b16_event_segments", """
    SELECT source_file, pos, coalesce(CAST(da_number AS BIGINT), -1) AS da_number, proc AS proc_da, round(score, 6) AS score FROM annotated_events""")
def event_segments(spark, sf_dir):
    """Segment numbers (B16) and back-filled labels (B17, B18), unlabelled words included."""
    return _annotated_events(spark, sf_dir).select(
        "source_file", "pos", F.coalesce("da_number", F.lit(-1)).alias("da_number"), "proc_da",
        F.round("score", 6).alias("score"))


@registered("b17_word_segments", """
    SELECT source_file, pos, coalesce(CAST(da_number AS BIGINT), -1) AS da_number, proc AS proc_da, round(score, 6) AS score FROM annotated_words""")
def word_segments(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _annotated(_scored(spark, sf_dir), t.word_order()).select(
        "source_file", "pos", F.coalesce("da_number", F.lit(-1)).alias("da_number"), "proc_da",
        F.round("score", 6).alias("score"))


@registered("b20_run_counters", """
    SELECT w.source_file, n_words, n_aligned, n_words - n_aligned AS n_unaligned, coalesce(n_windows, 0) AS n_windows
    FROM (SELECT source_file, count(*) AS n_words, count(pred_da) AS n_aligned FROM scored_words GROUP BY ALL) w
    LEFT JOIN (SELECT source_file, count(*) AS n_windows FROM window_rows GROUP BY ALL) USING (source_file)""")
def run_counters(spark, sf_dir):
    return W.run_counters(_scored(spark, sf_dir), _windows(spark, sf_dir))


@registered("b21_last_row_check", """
    SELECT source_file, arg_max(pred_da IS NOT DISTINCT FROM proc, pos) AS matches FROM annotated_events GROUP BY ALL""")
def last_row_check(spark, sf_dir):
    rows = _annotated_events(spark, sf_dir)
    return W.last_row_matches(rows, "pred_da", "proc_da")


@registered("c01_dialogue_acts", f"""
    SELECT source_file, CAST(da_number AS BIGINT) AS da_number, row_number() OVER (PARTITION BY source_file ORDER BY da_number) - 1 AS pos,
           speaker, proc AS proc_da, {oracle.extended('proc')} AS da_group, patient_important, therapist_important,
           patient_code, therapist_code, timestamp, spoken_text
    FROM (SELECT source_file, da_number, arg_min(speaker, pos) AS speaker, arg_max(proc, pos) AS proc,
            max(CAST(patient AS INT)) AS patient_important, max(CAST(therapist AS INT)) AS therapist_important,
            max(patient_code) AS patient_code, max(therapist_code) AS therapist_code, max(timestamp) AS timestamp,
            string_agg(spoken_text, ' ' ORDER BY pos) AS spoken_text
          FROM annotated_events WHERE da_number IS NOT NULL GROUP BY ALL) WHERE proc <> 'I-'""")
def dialogue_acts(spark, sf_dir):
    """Words collapsed to dialogue acts (C1), texts joined (C2), inside segments dropped."""
    order = tables(spark, sf_dir).order
    return W.collapse(_annotated_events(spark, sf_dir), order).select(
        "source_file", "da_number", "pos", "speaker", "proc_da", "da_group", "patient_important",
        "therapist_important", "patient_code", "therapist_code", "timestamp", "spoken_text")


@registered("c02_act_texts", f"""
    SELECT source_file, CAST(da_number AS BIGINT) AS da_number, pos // {W.PIECE_WORDS} AS piece,
           string_agg(spoken_text, ' ' ORDER BY pos) AS spoken_text
    FROM annotated_events SEMI JOIN (
      SELECT source_file, da_number FROM annotated_events WHERE da_number IS NOT NULL GROUP BY ALL
      HAVING arg_max(proc, pos) <> 'I-') USING (source_file, da_number)
    WHERE spoken_text IS NOT NULL GROUP BY ALL""")
def act_texts(spark, sf_dir):
    """Texts of dialogue acts (C2) in pieces of bounded size."""
    words = _annotated_events(spark, sf_dir)
    acts = W.collapse(words, tables(spark, sf_dir).order, texts=False)
    return W.act_texts(words, acts).select("source_file", "da_number", "piece", "spoken_text")


# --- sources and sinks -----------------------------------------------------------------

FILES = 20_000  # files of one folder, which the driver lists at once with some 6 KB each
_FILE = StructType([StructField("transcript", StringType()), StructField("row", LongType()), *TURN.fields])
_FILE_SQL = """
    SELECT source_file AS transcript, pos AS row, speaker, timestamp, CAST(patient AS INT) AS patient_important, patient_code,
           CAST(therapist AS INT) AS therapist_important, therapist_code, spoken_text FROM hub"""


def _file_rows(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir).hub().select(
        F.col("source_file").alias("transcript"), F.col("pos").alias("row"), *[f.name for f in TURN.fields])


def _round_trip(spark, sf_dir, extension: str) -> DataFrame:
    """Written as delimited files and read back by header through the declared layout."""
    path = folder(spark, extension)
    rows = _file_rows(spark, sf_dir)
    writers.write_delimited(rows, path, sep=readers.SEPARATORS[extension], extension=extension)
    read = readers.read_transcripts(spark, path, _FILE, required=["spoken_text"], multiline=False)
    return read.select(*[f.name for f in _FILE.fields])


# Empty text and missing text are the same in a delimited file.
_CSV_SQL = f"SELECT * REPLACE (nullif(therapist_code, '') AS therapist_code) FROM ({_FILE_SQL})"


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.withColumn("therapist_code", F.when(F.col("therapist_code") != "", F.col("therapist_code")))


@registered("a01_csv_files", _CSV_SQL)
def csv_files(spark, sf_dir):
    """CSV sink (A12) and scan of a directory."""
    return _blank_to_null(_round_trip(spark, sf_dir, "csv"))


@registered("a02_tsv_files", _CSV_SQL)
def tsv_files(spark, sf_dir):
    return _blank_to_null(_round_trip(spark, sf_dir, "tsv"))


@registered("a03_file_names", """
    SELECT source_file AS transcript, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows, max(pos) AS last_pos FROM hub GROUP BY ALL""")
def file_names(spark, sf_dir):
    """Rows know their file: written with one file per transcript, each transcript comes back under one
    name and its rows in order. The driver lists some thousand files at once, those of a batch's folder."""
    path = folder(spark, "named")
    rows = _file_rows(spark, sf_dir).withColumn("folder", F.col("transcript"))
    batches = max(1, math.ceil(rows.select("folder").distinct().count() / FILES))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("folder"), F.lit(batches)))
    # by number: files, not bytes, are the work of a task here, so tasks are not to be joined by their bytes
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")
    writers.write_delimited(dealt.sortWithinPartitions("batch", "folder", "row"), path, partition_by=["batch", "folder"])

    def found(below: str) -> DataFrame:
        read = readers.read_transcripts(spark, below, _FILE, multiline=False)
        return read.filter(F.col("row") == F.col("pos")).groupBy("transcript").agg(
            F.countDistinct("source_file").alias("n_files"), F.count("*").alias("n_rows"), F.max("pos").alias("last_pos"))

    if batches == 1:
        return found(path)
    used = sorted(r.batch for r in rows.select("batch").distinct().collect())
    return reduce(DataFrame.unionByName, [write_table(spark, "named", found(f"{path}/batch={b}")) for b in used])


def _mixed_folder(spark, sf_dir) -> str:
    """Transcripts in two column orders beside one file of each kind that is not to be read."""
    path, rows = folder(spark, "mixed"), _file_rows(spark, sf_dir)
    last = rows.columns[::-1]
    odd = F.xxhash64("transcript") % 2 == 0
    writers.write_delimited(rows.filter(odd), f"{path}/good")
    writers.write_delimited(rows.filter(~odd).select(*last), f"{path}/turned")
    one = rows.limit(1).coalesce(1)
    writers.write_delimited(one, f"{path}/=export")
    writers.write_delimited(one, f"{path}/sheet", extension="xlsx")
    writers.write_delimited(one.drop("spoken_text"), f"{path}/silent")
    writers.write_delimited(one.select(F.lit("x").alias("first"), F.lit("y").alias("second")), f"{path}/foreign")
    return path


_REFUSED = {"marked as broken": 1, "unknown extension": 1, "lacks spoken_text": 2}
_REFUSED_SQL = " UNION ALL ".join(f"SELECT '{reason}' AS outcome, CAST({n} AS BIGINT) AS n" for reason, n in _REFUSED.items())


def _data_files(files: DataFrame) -> DataFrame:
    """Without the marker files a sink leaves, which Spark's readers do not list either."""
    return files.filter(~F.col("source_file").rlike("^[_.]"))


@registered("a04_refused_files", f"SELECT 'read' AS outcome, count(*) AS n FROM hub UNION ALL {_REFUSED_SQL}")
def refused_files(spark, sf_dir):
    """Rows of the good files, and the files that were refused by reason."""
    path = _mixed_folder(spark, sf_dir)
    files = _data_files(readers.admitted(spark, path, ["spoken_text"], multiline=False))
    rows = readers.read_admitted(spark, files, _FILE, multiline=False).agg(F.lit("read").alias("outcome"), F.count("*").alias("n"))
    return rows.unionByName(files.filter("reason IS NOT NULL").groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n")))


@registered("a05_incremental_stream", _CSV_SQL)
def incremental_stream(spark, sf_dir):
    """Incremental ingest: two runs of the stream, the second of which finds nothing new."""
    path, out, refused, checkpoint = (folder(spark, n) for n in ("incoming", "ingested", "refused", "progress"))
    writers.write_delimited(_file_rows(spark, sf_dir), path)
    for _ in range(2):
        files = ingest.arriving_files(spark, path)
        ingest.ingest_new(files, _FILE, out, refused, checkpoint).awaitTermination()
    return _blank_to_null(spark.read.parquet(out).select(*[f.name for f in _FILE.fields]))


@registered("a07_isolated_files", f"SELECT 'read' AS outcome, 2 * count(*) AS n FROM hub UNION ALL {_REFUSED_SQL}")
def isolated_files(spark, sf_dir):
    """A stream over a folder with files that are refused: they stop neither the files that came with
    them nor those of a later run."""
    path = _mixed_folder(spark, sf_dir)
    out, refused, checkpoint = (folder(spark, n) for n in ("ingested", "refused", "progress"))
    for run in range(2):
        if run:
            writers.write_delimited(_file_rows(spark, sf_dir), f"{path}/later")
        files = ingest.arriving_files(spark, path)
        ingest.ingest_new(files, _FILE, out, refused, checkpoint, ["spoken_text"]).awaitTermination()
    rows = spark.read.parquet(out).agg(F.lit("read").alias("outcome"), F.count("*").alias("n"))
    return rows.unionByName(_data_files(spark.read.parquet(refused)).groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n")))


@registered("a08_missing_columns", f"""
    SELECT transcript, row, speaker, patient_code, CASE WHEN substr(transcript, 8, 2) <> 'T0' THEN nullif(therapist_code, '') END AS therapist_code
    FROM ({_FILE_SQL}) WHERE substr(transcript, 8, 2) <> 'T1'""")
def missing_columns(spark, sf_dir):
    """Files without an optional column have nulls there; files without a required one are left out."""
    path, rows = folder(spark, "lacking"), _file_rows(spark, sf_dir)
    rater = F.substring("transcript", 8, 2)
    writers.write_delimited(rows.filter(rater == "T0").drop("therapist_code"), f"{path}/a")
    writers.write_delimited(rows.filter(rater == "T1").drop("spoken_text"), f"{path}/b", sep="\t", extension="tsv")
    writers.write_delimited(rows.filter(~rater.isin("T0", "T1")), f"{path}/c", sep="\t", extension="tsv")
    read = readers.read_transcripts(spark, path, _FILE, required=["spoken_text"], multiline=False)
    return _blank_to_null(read).select("transcript", "row", "speaker", "patient_code", "therapist_code")


@registered("a06_unprocessed_files", """
    SELECT file_key, max(source_file) AS source_file FROM (
      SELECT DISTINCT source_file, array_to_string(string_split(source_file, '_')[1:5], '_') AS file_key FROM hub)
    WHERE file_key NOT IN (SELECT array_to_string(string_split(source_file, '_')[1:5], '_') FROM hub WHERE rater = '0')
    GROUP BY ALL""")
def unprocessed_files(spark, sf_dir):
    """File names (A3), one per key (A6), without keys already in the output (A5)."""
    files = tables(spark, sf_dir).hub().select("source_file").distinct()
    return readers.not_processed(files, files.filter(A.rater() == "0"))


@registered("a09_transcripts_with_positives", """
    SELECT source_file, count(*) AS n_rows FROM hub GROUP BY ALL HAVING count(*) FILTER (WHERE patient) > 0""")
def transcripts_with_positives(spark, sf_dir):
    t = tables(spark, sf_dir)
    return A.with_positives(t.hub(), t.order, "patient").groupBy("source_file").agg(
        F.count("*").alias("n_rows"))


@registered("a11_enough_transcripts", "SELECT source_file, count(*) AS n_rows FROM hub GROUP BY ALL")
def enough_transcripts(spark, sf_dir):
    """Rows pass on only with two transcripts or more."""
    hub = tables(spark, sf_dir).hub()
    return readers.require_groups(hub, "source_file", 2).groupBy("source_file").agg(
        F.count("*").alias("n_rows"))


_SUMMARY = StructType([
    StructField("rater", StringType()), StructField("n_sessions", LongType()),
    StructField("mean_rate", DoubleType()),
])


@registered("a14_metrics_file", """
    SELECT rater, count(*) AS n_sessions, round(avg(rate), 6) AS mean_rate FROM session_rates GROUP BY ALL""")
def metrics_file(spark, sf_dir):
    """A summary written as JSON (A14) and read again."""
    path = folder(spark, "metrics")
    rates = A.session_rates(tables(spark, sf_dir).hub(), "patient")
    writers.write_metrics(rates.groupBy("rater").agg(
        F.count("*").alias("n_sessions"), F.round(F.avg("rate"), 6).alias("mean_rate")), path)
    return writers.read_metrics(spark, path, _SUMMARY)

