"""Tails, corrections and tests against tables, enumeration and dense formulas."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import stats
from turnloom.operators import pairs as P
from turnloom.operators import significance as S


@pytest.mark.parametrize("x,dof,p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (18.307038053275146, 10, 0.05), (6.634896601021213, 1, 0.01), (124.34211340400407, 100, 0.05),
    (0.0, 3, 1.0), (1.0, 1, 0.31731050786291415),
])
def test_chi_square_tail_table(x, dof, p):
    assert stats.chi2_tail(np.array([x]), np.array([dof]))[0] == pytest.approx(p, abs=1e-9)


def test_wide_tail_meets_the_finite_sum():
    dof = 6000
    x = np.array([5800.0, 6000.0, 6200.0])
    half = x / 2
    exact = np.zeros(3)
    for i in range(dof // 2):
        exact += np.exp(i * np.log(half) - half - math.lgamma(i + 1))
    assert np.allclose(stats.chi2_tail(x, np.full(3, dof)), exact, atol=2e-6)


@pytest.mark.parametrize("n1,n2", [(2, 2), (2, 5), (3, 4), (5, 5)])
def test_exact_rank_sum_by_enumeration(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)]
    for u in set(us):
        larger = max(u, n1 * n2 - u)
        expected = min(1.0, 2 * sum(v >= larger for v in us) / len(us))
        assert stats.exact_rank_sum_p(u, n1, n2) == pytest.approx(expected)


def dense_bh(p):
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    out, best = [0.0] * m, 1.0
    for rank in range(m, 0, -1):
        best = min(best, p[order[rank - 1]] * m / rank)
        out[order[rank - 1]] = best
    return out


def test_benjamini_hochberg(spark):
    rng = random.Random(4)
    families = {
        "even": [rng.random() for _ in range(200)],
        "tied": [rng.choice([0.001, 0.02, 0.5, 1.0]) for _ in range(150)],
        "tiny": [10 ** -rng.uniform(0, 250) for _ in range(80)] + [0.0, 0.0],
        "one": [0.04],
    }
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)] + [("even", -1, None)]
    frame = spark.createDataFrame(rows, "family string, id long, p_value double")
    out = stats.benjamini_hochberg(frame, ["family"]).collect()
    got = {(r.family, r.id): (r.p_fdr, r.significant) for r in out}
    assert len(out) == len(rows)
    assert got["even", -1] == (None, False)
    for family, ps in families.items():
        for i, expected in enumerate(dense_bh(ps)):
            assert got[family, i][0] == pytest.approx(expected, rel=1e-12, abs=1e-300)
            assert got[family, i][1] == (expected < 0.05)


def dense_chi2(table):
    table = np.asarray(table, float)
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    difference = np.abs(table - expected)
    if table.shape == (2, 2):
        difference = difference - np.minimum(0.5, difference)
    return float((difference ** 2 / expected).sum())


def dense_js(a, b, log=np.log, eps=1e-10):
    p, q = np.asarray(a, float) + eps, np.asarray(b, float) + eps
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(0.5 * (p * log(p / m)).sum() + 0.5 * (q * log(q / m)).sum())


@pytest.fixture(scope="module")
def grouped(spark):
    rng = random.Random(8)
    table = {
        key: {g: [rng.choice([0, 0, 1, 3, 20]) for _ in range(m)] for g in "abcd"}
        for key, m in (("wide", 9), ("pair", 2), ("single", 1), ("apart", 4))
    }
    table["apart"] = {"a": [5, 3, 0, 0], "b": [0, 0, 2, 7], "c": [1, 0, 0, 0], "d": [0, 4, 0, 0]}
    for key in table:
        for g in table[key]:
            if not any(table[key][g]):
                table[key][g][0] = 2
    rows = [(k, g, f"f{i}", c) for k, gs in table.items() for g, cs in gs.items()
            for i, c in enumerate(cs) if c]
    return table, spark.createDataFrame(rows, "k string, g string, f string, cnt long")


def test_pairwise_chi_square_equals_dense_tables(grouped):
    table, frame = grouped
    got = {(r.k, r.a, r.b): r for r in P.chi_square(frame, ["k"], "g", "f", "cnt").collect()}
    assert len(got) == len(table) * 6
    for (k, a, b), r in got.items():
        columns = [(x, y) for x, y in zip(table[k][a], table[k][b]) if x + y]
        assert (r.n_a, r.n_b) == (sum(table[k][a]), sum(table[k][b]))
        if len(columns) < 2:
            assert r.chi2 is None and r.dof is None
        else:
            assert r.dof == len(columns) - 1
            assert r.chi2 == pytest.approx(dense_chi2(np.array(columns).T), abs=1e-9)


def test_divergences_equal_dense_vectors(grouped):
    table, frame = grouped
    natural = {(r.k, r.a, r.b): r.js for r in P.count_divergence(frame, ["k"], "g", "f", "cnt").collect()}
    base2 = {(r.k, r.a, r.b): r.js for r in P.frequency_divergence(frame, ["k"], "g", "f", "cnt").collect()}
    cosine = {(r.k, r.a, r.b): r.cosine for r in P.cosine(frame, ["k"], "g", "f", "cnt").collect()}
    for (k, a, b), js in natural.items():
        x, y = np.array(table[k][a], float), np.array(table[k][b], float)
        assert js == pytest.approx(dense_js(x, y), abs=1e-9)
        used = np.array([any(table[k][g][i] for g in table[k]) for i in range(len(x))])
        assert base2[k, a, b] == pytest.approx(
            dense_js(x[used] / x.sum(), y[used] / y.sum(), np.log2, 1e-9), abs=1e-12)
        assert cosine[k, a, b] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-12)
        assert 0 <= base2[k, a, b] <= 1 and 0 <= js <= math.log(2) + 1e-9


@pytest.mark.parametrize("k", [2, 3])
def test_pattern_chi_square_equals_dense_tables(spark, k):
    rng = random.Random(k)
    counts = {g: [rng.randint(0, 12) for _ in range(6)] for g in "abc"[:k]}
    rows = [(1, g, f"n{i}", c) for g, cs in counts.items() for i, c in enumerate(cs) if c]
    frame = spark.createDataFrame(rows, "n int, group string, ngram string, cnt long")
    sizes = spark.createDataFrame([(1, k)], "n int, n_groups long")
    got = {r.ngram: r for r in S.pattern_chi_square(frame, sizes, ["n"]).collect()}
    for i in range(6):
        row = [counts[g][i] for g in counts]
        if not sum(row):
            continue
        rest = [sum(counts[g]) - counts[g][i] for g in counts]
        r = got[f"n{i}"]
        assert r.chi2 == pytest.approx(dense_chi2([row, rest]), abs=1e-9)
        assert r.p_value == pytest.approx(
            stats.chi2_tail(np.array([r.chi2]), np.array([k - 1]))[0], abs=1e-12)


def test_a_group_without_ngrams_leaves_no_valid_test(spark):
    frame = spark.createDataFrame([(1, "a", "x", 5), (1, "b", "y", 5)], "n int, group string, ngram string, cnt long")
    sizes = spark.createDataFrame([(1, 3)], "n int, n_groups long")
    assert S.pattern_chi_square(frame, sizes, ["n"]).count() == 0


def dense_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def test_indicator_rank_test_counts_every_pair(spark):
    first, second = "AABBBCA", "ABBCCCCD"
    rows = [("c", s, x, text.count(x)) for s, text in (("important", first), ("nonimportant", second))
            for x in "ABCD" if text.count(x)]
    frame = spark.createDataFrame(rows, "comparison string, split string, label string, cnt long")
    got = S.indicator_rank_test(frame, ["comparison"], "important", "nonimportant").collect()
    assert {r.label for r in got} == set("ABCD")
    for r in got:
        x, y = [int(c == r.label) for c in first], [int(c == r.label) for c in second]
        assert r.u == pytest.approx(dense_u(x, y))


def test_rank_test_on_run_lengths(spark):
    data = {"tied": ([1, 1, 2, 5, 5, 9], [1, 2, 2, 3, 7]), "exact": ([1, 5], [2, 3, 9]), "few": ([1], [2, 3])}
    rows = [(k, v, side == 0) for k, sides in data.items() for side in (0, 1) for v in sides[side]]
    frame = spark.createDataFrame(rows, "k string, v long, important boolean")
    got = {r.k: r for r in S.rank_test(frame, ["k"], "v", F.col("important")).collect()}
    for k, (x, y) in data.items():
        r = got[k]
        assert (r.n1, r.n2) == (len(x), len(y))
        assert r.median_important == np.median(x) and r.max_other == max(y)
        if k == "few":
            assert r.u is None and r.p_value is None
        else:
            assert r.u == pytest.approx(dense_u(x, y))
    assert got["exact"].p_value == pytest.approx(stats.exact_rank_sum_p(dense_u(*data["exact"]), 2, 3))
    x, y = data["tied"]
    n, both = len(x) + len(y), x + y
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    variance = len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1)))
    u = max(dense_u(x, y), len(x) * len(y) - dense_u(x, y))
    z = (u - len(x) * len(y) / 2 - 0.5) / math.sqrt(variance)
    assert got["tied"].p_value == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0.0, 60.0), min_size=1, max_size=20), st.integers(1, 40))
def test_tail_is_a_decreasing_probability(values, dof):
    p = stats.chi2_tail(np.array(sorted(values)), np.full(len(values), dof))
    assert ((p >= 0) & (p <= 1)).all() and (np.diff(p) <= 1e-12).all()
