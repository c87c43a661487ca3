"""Hard negatives against brute force, and the packed products against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import hard_negatives as h


@pytest.mark.parametrize("reach,length,n", [(1, 3, 7), (150, 64, 33), (5_000, 64, 40), (1 << 24, 64, 1100), (0, 5, 4)])
def test_packed_products(reach, length, n):
    rng = np.random.default_rng(reach + length)
    x, a = rng.integers(-reach, reach + 1, (n, length)), rng.integers(-reach, reach + 1, (9, length))
    packed = h.Packed(x, int(a.min()), int(a.max()))
    assert (packed.scores(a) == a @ x.T).all()
    assert (packed.fields >= 2) == (reach <= 150)


def _brute(rows, positives=5, negatives=5):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        if any(abs(c) * 256 >= math.sqrt(2.0**55 / len(v)) - 1 for c in v):
            continue
        row = (str(label), [math.floor(c * 256) for c in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for i, (label, v) in kept.items():
        if i % 3:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, (other, w) in kept.items()
                        if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            band = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(i, j, n, k, -p, -s) for n, (s, k, _) in enumerate(band[:negatives], 1)]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _rows(seed, n=150, spread=1.0):
    rng = random.Random(seed)
    centre = [rng.gauss(0, 1) for _ in range(6)]
    made = [(i, [float(np.float32(c + rng.gauss(0, 0.3 * spread))) for c in centre], rng.choice([0, 0, 0, 1, 2, 9]))
            for i in range(n)]
    made += [(200 + i, made[5][1], 1 + i % 2) for i in range(40)]  # ties
    made += [(300, None, 1), (303, [], 1), (306, [1.0, None] * 3, 1), (309, [math.nan] * 6, 1), (312, [math.inf] * 6, 0),
             (315, made[0][1], None), (None, made[0][1], 1), (318, [0.0] * 6, 0), (321, [1e30] * 6, 0),
             (324, [0.5, 0.25], 4), (327, [0.5, 0.2], 4), (328, [0.5, 0.2], 5), (331, [0.5, 0.2], 7)]
    return made + [made[3], made[4], (6, made[7][1], 2)]  # repeated ids


@pytest.mark.parametrize("sizes", [(8192, 16384), (16, 7), (50, 1000)])
def test_mine(spark, sizes):
    rows = _rows(1)
    found = h.mine(spark, _table(spark, rows), F.col("vec_id") % 3 == 0, index_rows=sizes[0], anchor_rows=sizes[1])
    got = sorted(map(tuple, found.collect()))
    assert len(got) > 300 and got == _brute(rows)


def test_other_columns_empty_tables_and_no_anchors(spark):
    rows = _rows(2, 40)
    plain = _table(spark, rows)
    wide = plain.selectExpr("*", *[f"'q' AS {c}" for c in ("id", "x", "d", "asks", "home", "part", "lot", "wanted", "rank")])
    assert sorted(map(tuple, h.mine(spark, wide, F.col("vec_id") % 3 == 0).collect())) == _brute(rows)
    assert h.mine(spark, plain.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    assert h.mine(spark, plain, F.lit(False)).count() == 0


def test_large_components(spark):
    rows = [(i, [c * 40_000.0 for c in v] if v and None not in v else v, label) for i, v, label in _rows(3, 60)]
    rows = [(i, v and [c if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    got = sorted(map(tuple, h.mine(spark, _table(spark, rows), F.col("vec_id") % 3 == 0).collect()))
    assert got == _brute(rows)
