"""Nearest distributions of other owners against a comparison of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import nearest as NN

SCHEMA = "slice string, rater string, code string, label string, cnt long"


def divergence(x, y):
    n, m = sum(x.values()), sum(y.values())
    out = 0.0
    for f in {*x, *y}:
        p, q = x.get(f, 0) / n, y.get(f, 0) / m
        out += 0.5 * (p * math.log(2 * p / (p + q)) if p else 0) + 0.5 * (q * math.log(2 * q / (p + q)) if q else 0)
    return max(out, 0.0)


def items_of(seed, raters, codes, styles, labels=8):
    """Raters follow one of a few styles, so items lie in clusters; some repeat another's counts."""
    rng, items = random.Random(seed), {}
    weights = [[rng.random() ** 6 for _ in range(labels)] for _ in range(styles)]
    for s in ("all", "one"):
        for r in range(raters):
            for c in range(rng.randrange(1, codes + 1)):
                if items and rng.random() < 0.2:
                    counts = {f: 2 * v for f, v in rng.choice(list(items.values())).items()}
                else:
                    drawn = rng.choices(range(labels), rng.choice(weights), k=rng.choice([1, 3, 400]))
                    counts = {f"L{f}": drawn.count(f) for f in set(drawn)}
                items[(s, f"r{r:03d}", f"c{c}")] = counts
    return items


def rows_of(items):
    return [(*key, f, v) for key, counts in items.items() for f, v in counts.items()]


def all_pairs(items, k):
    found = {}
    for (s, r, c), x in items.items():
        ranked = sorted((round(divergence(x, y), 4), o, d) for (t, o, d), y in items.items() if t == s and o != r)
        found[(s, r, c)] = ranked[:k]
    return found


def result_of(rows):
    out = {}
    for x in sorted(rows, key=lambda x: x["rank"]):
        out.setdefault((x["slice"], x["rater"], x["code"]), []).append((round(x["js"], 4), x["other_owner"], x["other_item"]))
    return out


def agree(got, expected):
    """Equal but for divergences on the edge of two rounded values."""
    assert set(got) == {key for key, ranked in expected.items() if ranked}
    for key, ranked in got.items():
        assert len(ranked) == len(expected[key])
        assert [x[0] for x in ranked] == pytest.approx([x[0] for x in expected[key]], abs=1.01e-4)
    assert sum(got[key] == expected[key] for key in got) >= 0.99 * len(got)


@pytest.mark.parametrize("seed, raters, codes, styles, k", [(1, 25, 3, 4, 3), (2, 3, 4, 2, 5), (3, 40, 1, 40, 1)])
def test_equals_all_pairs(spark, seed, raters, codes, styles, k):
    items = items_of(seed, raters, codes, styles)
    df = spark.createDataFrame(rows_of(items), SCHEMA)
    got = NN.nearest(df, ["slice"], "rater", "code", "label", "cnt", k, pivots=8)
    agree(result_of(got.collect()), all_pairs(items, k))


def test_few_pairs_meet_where_items_lie_in_clusters(spark):
    items = {key: counts for key, counts in items_of(7, 200, 3, 12).items() if sum(counts.values()) >= 100}
    df = spark.createDataFrame(rows_of(items), SCHEMA)
    members, shares = NN.distribution_classes(df, ["slice"], "rater", "code", "label", "cnt")
    classes = shares.select("slice", "class").distinct().groupBy("slice").count().collect()
    met = NN.candidates(members, shares, ["slice"], "rater", 3).count()
    assert met < 0.3 * sum(x["count"] ** 2 for x in classes)
    got = NN.nearest(df, ["slice"], "rater", "code", "label", "cnt", 3)
    agree(result_of(got.collect()), all_pairs(items, 3))


def test_equal_items_meet_once(spark):
    """A thousand raters with the same shares are one class, and each has its first others."""
    df = spark.range(1000).select(
        F.lit("all").alias("slice"), F.format_string("r%04d", "id").alias("rater"), F.lit("c").alias("code"),
        F.explode(F.array(F.lit("x"), F.lit("y"))).alias("label"), (F.col("id") + 1).alias("cnt"))
    members, shares = NN.distribution_classes(df, ["slice"], "rater", "code", "label", "cnt")
    assert NN.candidates(members, shares, ["slice"], "rater", 3).count() == 1
    got = result_of(NN.nearest(df, ["slice"], "rater", "code", "label", "cnt", 3).collect())
    assert len(got) == 1000
    assert got[("all", "r0001", "c")] == [(0.0, "r0000", "c"), (0.0, "r0002", "c"), (0.0, "r0003", "c")]


def test_nobody_to_meet(spark):
    one = spark.createDataFrame([("all", "r", "c", "x", 2), ("all", "r", "d", "y", 1)], SCHEMA)
    assert NN.nearest(one, ["slice"], "rater", "code", "label", "cnt", 3).count() == 0
    assert NN.nearest(one.limit(0), ["slice"], "rater", "code", "label", "cnt", 3).count() == 0
