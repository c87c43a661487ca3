"""Running totals over keys of any size, and names a group lacks, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import ngrams as N
from turnloom.operators.ordered import running_total


@pytest.mark.parametrize("parts", [1, 5])
def test_running_totals(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("aaaab"), i, rng.randrange(9)) for i in rng.sample(range(2000), 500)] + [("c", 0, 3), (None, 1, 4), (None, 2, 5)]
    frame = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = running_total(frame.where("k IS NOT NULL"), ["k"], ["i"], F.col("v"), "upto").collect()
        every = running_total(frame, [], ["i", "k"], name="place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for r in got:
        assert r.upto == sum(v for k, i, v in rows if k == r.k and i < r.i)
    order = sorted((i, k or "") for k, i, _ in rows)
    assert {(r.i, r.k or ""): r.place for r in every} == {x: n for n, x in enumerate(order)}
    assert running_total(frame.limit(0), ["k"], ["i"]).count() == 0


@pytest.mark.parametrize("top", [1, 3, 10])
def test_dominant_fills_with_the_first_names_a_group_lacks(spark, top):
    rng, scored = random.Random(top), []
    vocabulary = [f"g{i:02d}" for i in range(30)]
    for n in (2, 3):
        for group in range(12):
            present = rng.sample(vocabulary, rng.choice([1, 4, 28, 30]))
            scored += [("l", n, f"x{group}", g, rng.choice([-0.5, 0.0, 0.2, 0.7]), 0.1) for g in present]
    frame = spark.createDataFrame(scored, "level string, n int, group string, ngram string, tfidf double, freq double")
    got = {(r.n, r.group, r["rank"]): (r.ngram, r.tfidf) for r in N.dominant(frame, ["level", "n"], top).collect()}
    want = {}
    for n in (2, 3):
        known = {g for _, m, _, g, *_ in scored if m == n}
        for group in {x[2] for x in scored}:
            own = {g: s for _, m, x, g, s, _ in scored if (m, x) == (n, group)}
            ranked = sorted(((own.get(g, 0.0), g) for g in known), key=lambda x: (-x[0], x[1]))[:top]
            want.update({(n, group, i): (g, s) for i, (s, g) in enumerate(ranked, 1)})
    assert got == want
