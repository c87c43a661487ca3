"""Files: layouts found by header, broken exports, numbering, and incremental ingest."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import words as W
from turnloom.operators.ordered import Ordering
from turnloom.plans import annotation
from turnloom.schemas import OLD_WORD, TURN, WORD
from turnloom.sources import readers, writers
from turnloom.streaming import ingest

TURN_HEADER = "speaker,timestamp,patient_important,patient_code,therapist_important,therapist_code,spoken_text"
TURN_ROWS = [
    'S1,0:00,0,,0,,"Hello, how are you doing today?"',
    "Therapist,0:05,1,,0,,I am good. What should we talk about today?",
    "S1,0:08,0,,1,,I think talking about classes would be the most helpful.",
]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "one.csv").write_text("\n".join([TURN_HEADER, *TURN_ROWS]) + "\n")
    # other column order, a line break inside quotes, a column nobody asked for
    (tmp_path / "two.csv").write_text(
        'spoken_text,extra,speaker,patient_important\n"two\nlines",9,S2,1\n"say ""hi""",8,S3,\n')
    (tmp_path / "tabs.tsv").write_text(TURN_HEADER.replace(",", "\t") + "\nS4\t0:01\t1\tIAI, VLD\t0\t\ta, b\n")
    (tmp_path / "=broken.csv").write_text(TURN_HEADER + "\nS9,0:00,1,,1,,no\n")
    (tmp_path / "no_text.csv").write_text("speaker,patient_important\nS5,1\n")
    (tmp_path / "notes.md").write_text("not a transcript")
    return str(tmp_path)


def test_files_are_read_by_header(spark, folder):
    rows = readers.read_transcripts(spark, folder, TURN, required=["spoken_text"])
    got = {(r.source_file, r.pos): (r.speaker, r.patient_important, r.patient_code, r.spoken_text) for r in rows.collect()}
    assert got == {
        ("one.csv", 0): ("S1", 0, None, "Hello, how are you doing today?"),
        ("one.csv", 1): ("Therapist", 1, None, "I am good. What should we talk about today?"),
        ("one.csv", 2): ("S1", 0, None, "I think talking about classes would be the most helpful."),
        ("two.csv", 0): ("S2", 1, None, "two\nlines"),
        ("two.csv", 1): ("S3", None, None, 'say "hi"'),
        ("tabs.tsv", 0): ("S4", 1, "IAI, VLD", "a, b"),
    }


def test_missing_columns_are_null_when_not_required(spark, folder):
    rows = readers.read_transcripts(spark, folder, TURN)
    assert {r.source_file for r in rows.collect()} == {"one.csv", "two.csv", "tabs.tsv", "no_text.csv"}


def test_malformed_values_do_not_stop_the_read(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(TURN_HEADER + "\nS1,0:00,oops,,0,,text\nS2,0:01,1,,0,,fine\n")
    rows = readers.read_transcripts(spark, str(tmp_path), TURN).orderBy("pos").collect()
    assert [(r.speaker, r.patient_important) for r in rows] == [("S1", None), ("S2", 1)]
    assert rows[0][readers.CORRUPT] is not None and rows[1][readers.CORRUPT] is None


def test_splittable_files_keep_their_order(spark, tmp_path):
    (tmp_path / "long.csv").write_text(
        "speaker,spoken_text\n" + "".join(f"S1,line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = readers.read_transcripts(spark, str(tmp_path), TURN, multiline=False)
        assert rows.filter(F.col("spoken_text") != F.concat_ws(" ", F.lit("line"), "pos")).count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_numbered_whole_and_by_block(spark, tmp_path, monkeypatch):
    """Small and large files beside each other, split by the scan; small ones are read once."""
    (tmp_path / "small.csv").write_text("speaker,spoken_text\n" + "".join(f"S1,line {i}\n" for i in range(900)))
    (tmp_path / "large.csv").write_text("speaker,spoken_text\n" + "".join(f"S2,line {i}\n" for i in range(2000)))
    kinds = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        monkeypatch.setattr(readers, "WHOLE_BYTES", 15_000)
        for multiline in (False, True):
            rows = readers.read_transcripts(spark, str(tmp_path), TURN, multiline=multiline).select("source_file", "pos", "spoken_text")
            assert rows.filter(F.col("spoken_text") != F.concat_ws(" ", F.lit("line"), "pos")).count() == 0
            assert {r.source_file: r["count"] for r in rows.groupBy("source_file").count().collect()} == {"small.csv": 900, "large.csv": 2000}
        monkeypatch.setattr(readers, "WHOLE_BYTES", 1 << 26)
        plan = readers.read_transcripts(spark, str(tmp_path), TURN, multiline=False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan csv") == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kinds)


def test_folders_are_not_listed_by_a_task_each(spark, tmp_path):
    context, cores = spark.sparkContext, spark.sparkContext.defaultParallelism
    for i in range(max(60, 4 * cores + 20)):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.csv").write_text(f"speaker,spoken_text\nS1,text {i}\n")
    before = spark.conf.get(readers.LISTING, None)
    context.setJobGroup("listing", "listing")
    try:
        files = readers.listed(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * cores
    assert spark.conf.get(readers.LISTING, None) == before
    assert files.count() == max(60, 4 * cores + 20)


def test_transcripts_are_read_in_batches(spark, tmp_path, monkeypatch):
    """The driver never lists the files of all transcripts at once; every transcript is one file with all its rows."""
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:{i // 60:02d}", i % 13, "view", 50.0, '{"k": 1}') for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    most, listed = [], readers.listed

    def counted(spark, path):
        files = listed(spark, path)
        most.append(files.filter("extension = 'csv'").count())
        return files

    monkeypatch.setattr(readers, "listed", counted)
    monkeypatch.setattr(annotation, "FILES", 4, raising=False)
    got = {r.transcript: (r.n_files, r.n_rows, r.last_pos) for r in annotation.file_names(spark, str(tmp_path)).collect()}
    counts = {u: sum(r[2] == u for r in rows) for u in range(13)}
    assert got == {f"sessionT{u % 5}_with_AC{u % 20:02d}_{u}.csv": (1, n, n - 1) for u, n in counts.items()}
    assert sum(most) == 13 and max(most) < 13 and len(most) > 1


def test_each_refused_file_has_its_reason(spark, folder):
    import pathlib
    base = pathlib.Path(folder)
    (base / "sheet.xlsx").write_text("x")
    (base / "twice.csv").write_text("speaker,spoken_text,speaker\na,b,c\n")
    (base / "foreign.csv").write_text("first,second\n1,2\n")
    (base / "empty.csv").write_text("")
    (base / "=old").mkdir()
    (base / "=old" / "kept.csv").write_text("\n".join([TURN_HEADER, *TURN_ROWS]) + "\n")
    files = readers.admitted(spark, folder, ["speaker"], ["speaker"], max_file_bytes=10_000)
    assert {r.source_file: r.reason for r in files.collect()} == {
        "one.csv": None, "two.csv": None, "tabs.tsv": None, "no_text.csv": None, "=broken.csv": "marked as broken",
        "kept.csv": "marked as broken", "notes.md": "unknown extension", "sheet.xlsx": "unknown extension",
        "twice.csv": "column named twice", "foreign.csv": "lacks speaker"}
    known = readers.admitted(spark, folder, (), ["speaker"]).filter("reason = 'foreign header'").collect()
    assert [r.source_file for r in known] == ["foreign.csv"]
    rows = readers.read_transcripts(spark, folder, TURN, required=["spoken_text"])
    assert {r.source_file for r in rows.collect()} == {"one.csv", "two.csv", "tabs.tsv"}


def test_files_of_one_name_in_two_folders_keep_their_own_positions(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same.csv").write_text("\n".join([TURN_HEADER, *TURN_ROWS]) + "\n")
    rows = readers.read_transcripts(spark, str(tmp_path), TURN)
    assert sorted(r.pos for r in rows.collect()) == [0, 0, 1, 1, 2, 2]


def test_many_headers(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.csv").write_text(f"extra{i},spoken_text,speaker\n{i},text {i},S{i}\n")
    rows = readers.read_transcripts(spark, str(tmp_path), TURN, required=["spoken_text"])
    assert {(r.source_file, r.spoken_text, r.speaker) for r in rows.collect()} == {
        (f"f{i}.csv", f"text {i}", f"S{i}") for i in range(30)}


def test_large_files_need_the_splittable_reader(spark, tmp_path):
    (tmp_path / "one.csv").write_text("\n".join([TURN_HEADER, *TURN_ROWS]) + "\n")
    (tmp_path / "two.csv").write_text(TURN_HEADER + "\n")
    refused = readers.admitted(spark, str(tmp_path), max_file_bytes=100).filter("reason IS NOT NULL").collect()
    assert [(r.source_file, r.reason) for r in refused] == [("one.csv", "too large for one task")]
    assert readers.read_transcripts(spark, str(tmp_path), TURN, multiline=False, max_file_bytes=10).count() == 3


def test_older_word_layout(spark, tmp_path):
    (tmp_path / "words.csv").write_text(
        "speaker,spoken_text,label,confidence,label class,DA number\n"
        "1,Hello,Conventional-opening,0.9,Conventional-opening,1\n1,how,I-,0.3,Open-Question,2\n"
        "1,today,Open-Question,0.8,Open-Question,2\n")
    words = readers.read_old_words(spark, str(tmp_path), WORD)
    assert set(OLD_WORD.values()) <= set(words.columns)
    acts = W.collapse(
        words.withColumnsRenamed({"Proc_DA": "proc_da", "DA_number": "da_number"}), Ordering()).orderBy("pos")
    assert [(a.pos, a.proc_da, a.spoken_text) for a in acts.collect()] == [
        (0, "Conventional-opening", "Hello"), (1, "Open-Question", "how today")]


def test_older_word_layout_is_read_by_name(spark, tmp_path):
    (tmp_path / "turned.csv").write_text(
        "spoken_text,speaker,label,DA number,confidence,label class\nHello,S1,Wh-Question,7,0.5,Open-Question\n")
    (tmp_path / "foreign.csv").write_text("a,b,c,d,e,f\n1,2,3,4,5,6\n")
    (tmp_path / "short.csv").write_text("spoken_text,speaker\nHi,S2\n")
    rows = readers.read_old_words(spark, str(tmp_path), WORD).collect()
    assert [(r.speaker, r.spoken_text, r.Pred_DA, r.Raw_Score, r.Proc_DA, r.DA_number) for r in rows] == [
        ("S1", "Hello", "Wh-Question", 0.5, "Open-Question", 7)]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "notes.md").write_text("x")
    assert readers.read_transcripts(spark, str(tmp_path), TURN).count() == 0


def test_keys_and_unprocessed_files(spark):
    names = ["a_b_c_d_e_1.csv", "a_b_c_d_e_2.csv", "x_y.csv", "p_q_r_s_t_u.csv"]
    files = spark.createDataFrame([(n,) for n in names], "source_file string")
    done = spark.createDataFrame([("p_q_r_s_t_with_predictions.csv",)], "source_file string")
    got = {r.file_key: r.source_file for r in readers.not_processed(files, done).collect()}
    assert got == {"a_b_c_d_e": "a_b_c_d_e_2.csv", "x_y.csv": "x_y.csv"}


def test_group_guard(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert readers.require_groups(frame, "k", 2).count() == 3
    assert readers.require_groups(frame, "k", 3).count() == 0


def test_stream_takes_each_file_once_and_none_stops_the_others(spark, tmp_path):
    source, out, refused, progress = (str(tmp_path / n) for n in ("in", "out", "refused", "progress"))
    (tmp_path / "in").mkdir()

    def run():
        files = ingest.arriving_files(spark, source, files_per_batch=3)
        ingest.ingest_new(files, TURN, out, refused, progress, ["spoken_text"]).awaitTermination()
        return spark.read.parquet(out)

    (tmp_path / "in" / "one.csv").write_text("\n".join([TURN_HEADER, *TURN_ROWS]) + "\n")
    (tmp_path / "in" / "=bad.csv").write_text("\n".join([TURN_HEADER, TURN_ROWS[0]]) + "\n")
    (tmp_path / "in" / "foreign.csv").write_text("first,second\n1,2\n")
    (tmp_path / "in" / "turned.csv").write_text("spoken_text,speaker\nhi,S1\n")
    assert run().count() == 4
    assert run().count() == 4
    (tmp_path / "in" / "two.csv").write_text("\n".join([TURN_HEADER, TURN_ROWS[1]]) + "\n")
    (tmp_path / "in" / "other.csv").write_text("third\n3\n")
    after = run()
    assert {r.source_file: r["count"] for r in after.groupBy("source_file").count().collect()} == {
        "one.csv": 3, "turned.csv": 1, "two.csv": 1}
    turned = after.filter("source_file = 'turned.csv'").first()
    assert (turned.speaker, turned.spoken_text) == ("S1", "hi")
    assert {r.source_file: r.reason for r in spark.read.parquet(refused).collect()} == {
        "=bad.csv": "marked as broken", "foreign.csv": "lacks spoken_text", "other.csv": "lacks spoken_text"}


def test_stream_runs_a_batch_function(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("\n".join([TURN_HEADER, *TURN_ROWS]) + "\n")
    target = str(tmp_path / "words")

    def handle(batch, _):
        turns = batch.withColumnRenamed("pos", "turn")
        W.turn_words(W.clean_turns(turns), Ordering(pos="turn")).write.mode("append").parquet(target)

    files = ingest.arriving_files(spark, str(tmp_path / "in"))
    ingest.process_new(files, TURN, handle, str(tmp_path / "refused"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(target).count() == 25


def test_matrix_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.2), ("b", "c", 0.9)], "a string, b string, v double")
    wide = writers.matrix(writers.mirrored(pairs, "v", 0.0), "a", "b", "v", ["a", "b", "c"]).orderBy("a")
    assert [tuple(r) for r in wide.collect()] == [("a", 0.0, 0.5, 0.2), ("b", 0.5, 0.0, 0.9), ("c", 0.2, 0.9, 0.0)]
    writers.write_parquet(pairs, str(tmp_path / "p"), ["a"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
