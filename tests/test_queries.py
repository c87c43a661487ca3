"""Every registered query against its SQL on DuckDB, plain and with tiny segments."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.conftest import DATA
from turnloom.plans import tables as T

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
SF_DIR = os.path.join(DATA, "sf0.01")
# queries that read positions of a transcript, where segments could matter
ORDERED = [n for n in ORACLES if n.split("_")[0] in {
    "b04", "b08", "b11", "b16", "b17", "c01", "c11", "d01", "d02", "d06", "d07", "d10", "e01", "e02",
    "e06", "e16", "f12", "h01", "i04", "k13", "l03", "l04", "l05", "l14", "a09", "c19"}]


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare(df, oracle, ORACLES[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_tiny_segments(spark, oracle, name, monkeypatch):
    key = (spark.sparkContext.applicationId, SF_DIR)
    small = _small(spark)
    assert small.order.segment_rows == 16 and small.word_order().segment_rows == 16
    monkeypatch.setitem(T._TABLES, key, small)
    assert compare(QUERIES[name](spark, SF_DIR), oracle, ORACLES[name]) is None


_SMALL = {}


def _small(spark):
    return _SMALL.setdefault(spark.sparkContext.applicationId, T.Tables(spark, SF_DIR, segment_rows=16))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_partitioning_does_not_change_results(spark, oracle, partitions, monkeypatch):
    key = (spark.sparkContext.applicationId, SF_DIR)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        monkeypatch.setitem(T._TABLES, key, T.Tables(spark, SF_DIR, segment_rows=32))
        for name in ("d01_patient_blocks", "e04_top_patterns", "b08_packed_windows", "l05_loss_mask"):
            assert compare(QUERIES[name](spark, SF_DIR), oracle, ORACLES[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
