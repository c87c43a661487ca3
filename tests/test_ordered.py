"""Segmented primitives against plain Python, for every segment length."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators.ordered import Ordering, ahead, carry, nearby, number_by_time, overall, renumber

LENGTHS = {"a": 23, "b": 1, "c": 8, "d": 64}
SEGMENTS = [None, 1, 2, 3, 7, 64, 1000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return {
        name: [(pos, rng.choice("xyz"), rng.choice([None, None, rng.randint(0, 9)])) for pos in range(n)]
        for name, n in LENGTHS.items()
    }


@pytest.fixture(scope="module")
def frame(spark, rows):
    flat = [(name, *row) for name, all_rows in rows.items() for row in all_rows]
    random.Random(2).shuffle(flat)
    return spark.createDataFrame(flat, "source_file string, pos long, label string, value long")


def collected(df, *columns):
    return {(r.source_file, r.pos): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("segment", SEGMENTS)
def test_nearby_sees_exact_neighbours(frame, rows, segment):
    order = Ordering(segment_rows=segment)
    out = nearby(frame, order, {
        "before": lambda w: F.lag("label", 2).over(w),
        "after": lambda w: F.lead("label", 3).over(w),
        "total": lambda w: F.sum("pos").over(w.rowsBetween(-2, 3)),
    }, before=2, after=3)
    got = collected(out, "before", "after", "total")
    for name, items in rows.items():
        n = len(items)
        for i in range(n):
            expected = (
                items[i - 2][1] if i >= 2 else None,
                items[i + 3][1] if i + 3 < n else None,
                sum(range(max(0, i - 2), min(n, i + 4))),
            )
            assert got[name, i] == expected
    assert len(got) == sum(LENGTHS.values())


@pytest.mark.parametrize("segment", SEGMENTS)
def test_carry_crosses_segments(frame, rows, segment):
    out = carry(
        frame, Ordering(segment_rows=segment),
        latest={"latest": F.col("value")}, upcoming={"upcoming": F.col("value")},
        running={"running": F.coalesce("value", F.lit(0))},
    )
    got = collected(out, "latest", "upcoming", "running")
    for name, items in rows.items():
        values = [v for _, _, v in items]
        for i in range(len(values)):
            past = [v for v in values[: i + 1] if v is not None]
            future = [v for v in values[i:] if v is not None]
            assert got[name, i] == (
                past[-1] if past else None, future[0] if future else None, sum(past))


@pytest.mark.parametrize("segment", SEGMENTS)
def test_ahead_skips_gaps_and_empty_segments(frame, rows, segment):
    kept = frame.filter((F.col("label") == "x") | (F.col("pos") > 50))
    out = ahead(kept, Ordering(segment_rows=segment), 3, ["label"], {
        f"l{i}": (lambda w, i=i: F.lead("label", i).over(w)) for i in (1, 2, 3)})
    got = collected(out, "l1", "l2", "l3")
    for name, items in rows.items():
        left = [(p, x) for p, x, _ in items if x == "x" or p > 50]
        for i, (p, _) in enumerate(left):
            expected = tuple(left[i + k][1] if i + k < len(left) else None for k in (1, 2, 3))
            assert got[name, p] == expected


@pytest.mark.parametrize("segment", SEGMENTS)
def test_renumber_closes_gaps(frame, rows, segment):
    kept = frame.filter(F.col("label") != "y").withColumn("old", F.col("pos"))
    out = renumber(kept, Ordering(segment_rows=segment, pos="old"))
    got = {(r.source_file, r.old): r.pos for r in out.collect()}
    for name, items in rows.items():
        for new, old in enumerate(p for p, x, _ in items if x != "y"):
            assert got[name, old] == new


@pytest.mark.parametrize("segment", SEGMENTS)
def test_overall_reaches_every_row(frame, rows, segment):
    out = overall(frame, Ordering(segment_rows=segment), {
        "low": ("min", F.col("value")), "high": ("max", F.col("value")), "total": ("sum", F.col("pos"))})
    got = collected(out, "low", "high", "total")
    for name, items in rows.items():
        values = [v for _, _, v in items if v is not None]
        for pos, _, _ in items:
            assert got[name, pos] == (
                min(values, default=None), max(values, default=None), sum(range(len(items))))


@pytest.mark.parametrize("segment", [None, 1, 4, 1000])
def test_number_by_time_with_bursts_and_ties(spark, segment):
    rng = random.Random(3)
    rows = []
    for name, n in LENGTHS.items():
        times = [rng.choice([0, 1, 1, 2, 10_000, 10_001, 500_000]) for _ in range(n)]
        rows += [(name, t, i) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "source_file string, t long, id long").withColumn(
        "ts", F.timestamp_seconds("t"))
    out = number_by_time(frame, "source_file", "ts", ["id"], segment_rows=segment)
    got = {(r.source_file, r.id): r.pos for r in out.collect()}
    for name in LENGTHS:
        mine = sorted((t, i) for s, t, i in rows if s == name)
        for pos, (_, i) in enumerate(mine):
            assert got[name, i] == pos


def test_one_sequence_with_most_rows_is_split(spark):
    """A source holding nearly all rows is spread over many (source, segment) groups."""
    order = Ordering(segment_rows=1000)
    frame = spark.range(50_000).select(
        F.lit("hot").alias("source_file"), F.col("id").alias("pos"))
    sizes = frame.groupBy("source_file", order.segment().alias("s")).count()
    assert sizes.agg(F.max("count")).first()[0] == 1000
    total = carry(frame, order, running={"n": F.lit(1).cast("long")})
    assert total.filter(F.col("n") != F.col("pos") + 1).count() == 0
