"""Shared tables follow their input, and the folder of an application can be emptied."""

import os

from pyspark.sql import functions as F

from tests.conftest import DATA
from turnloom import session
from turnloom.plans import tables as T

SF_DIR = os.path.join(DATA, "sf0.001")


def test_tables_follow_their_input(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    folder, path = str(tmp_path), str(tmp_path / "events.parquet")
    events.where("event_id % 2 = 0").write.parquet(path)
    before = T.tables(spark, folder)
    few = before.hub().count()
    assert T.tables(spark, folder) is before
    events.where("event_id % 2 = 1").write.mode("append").parquet(path)
    after = T.tables(spark, folder)
    assert after is not before and after.hub().count() > few
    assert T.tables(spark, folder) is after
    del T._TABLES[spark.sparkContext.applicationId, folder]


def test_state_of_missing_paths(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert session.state(spark, [missing]) == ((missing, None),)
    (tmp_path / "none").write_text("x")
    assert session.state(spark, [missing])[0][1:3] == (1, 1)


def test_clear_deletes_what_the_application_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(T, "_TABLES", {(spark.sparkContext.applicationId, "x"): None, ("other", "x"): None})
    other = tmp_path / "turnloom" / "other"
    other.mkdir(parents=True)
    assert session.write_table(spark, "t", spark.range(5)).count() == 5
    assert os.path.isdir(session.tables_folder(spark))
    T.clear(spark)
    assert not os.path.exists(session.tables_folder(spark)) and other.is_dir()
    assert list(T._TABLES) == [("other", "x")]
    T.clear(spark)  # nothing left to delete


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {kind for kind in ("BroadcastHashJoin", "SortMergeJoin") if kind in plan}


def test_large_written_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    large = session.write_table(spark, "large", spark.range(1000), small_rows=999)
    small = session.write_table(spark, "small", spark.range(1000), small_rows=1000)
    assert joins(spark.range(1 << 20).join(large.groupBy("id").count(), "id")) == {"SortMergeJoin"}
    assert joins(spark.range(1 << 20).join(small, "id")) == {"BroadcastHashJoin"}
    assert large.count() == 1000


def test_written_joins_go_by_measured_sizes(spark):
    before = [spark.conf.get(key, None) for key in (session.STATIC, session.ADAPTIVE)]
    with session.measured_joins(spark):
        assert joins(spark.range(1 << 20).join(spark.range(1000), "id")) == {"SortMergeJoin"}
    assert [spark.conf.get(key, None) for key in (session.STATIC, session.ADAPTIVE)] == before
    assert joins(spark.range(1 << 20).join(spark.range(1000), "id")) == {"BroadcastHashJoin"}


def test_sides_of_some_mb_are_not_sent(spark):
    rows = spark.range(200_000).groupBy("id").count()
    with session.measured_joins(spark):
        joined = spark.range(1 << 20).join(rows, "id").agg(F.count("*"))
        assert joined.collect()[0][0] == 200_000
    assert joins(joined) == {"SortMergeJoin"}


def test_tasks_of_written_tables_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    keys = (session.SHUFFLED, session.INITIAL)
    before = [spark.conf.get(key, None) for key in keys]
    many = session.write_table(spark, "many", spark.range(1 << 22).groupBy("id").count())
    assert [spark.conf.get(key, None) for key in keys] == before
    rows = [r["count"] for r in many.groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) == 1 << 22 and max(rows) <= 1 << 20
