"""Toxic segments, the line field and nearest neighbours: brute force and held-out accuracy."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import cases
from turnloom.llm import ann, labelled, line_crf, queries, toxicity

SF_DIR = os.path.join(DATA, "sf0.01")


def brute_segments(scores):
    """Maximal segments by their recursive definition: the best one, then left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
               default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3:]
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(400):
        n, drift = rng.randrange(1, 25), rng.choice([0.3, 0.7, 1.0])
        hits = [(i, rng.uniform(0.2, 2.0)) for i in range(n) if rng.random() < 0.4]
        scores = [dict(hits).get(i, -drift) for i in range(n)]
        got = toxicity.segments(hits, drift)
        assert [(a, b + 1) for a, b, _ in got] == brute_segments(scores)
        for a, b, s in got:
            assert math.isclose(s, sum(scores[a:b + 1]))


def test_toxicity_on_awkward_rows(spark):
    model = toxicity.Model({"vile": 6.0, "foo*": 5.0, "fooled": 0.0}, 1.0, 0.01, 2.0, -3.0)
    docs = cases.table(spark, cases.texts() + [(90, "You VILE foobar"), (91, "fooled nobody")])
    got = {r.doc_id: r for r in toxicity.score(cases.clashing(spark, docs), model).collect() if r.doc_id}
    assert got[90].score > 0.5 > got[91].score == got[1].score == got[2].score
    spans = toxicity.passages(docs, model).collect()
    assert [(r.doc_id, r.start, r.end) for r in spans] == [(90, 4, 15)]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.Model()).select("score").distinct().count() == 1


def accuracy(spark, out, label):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    right = {y: [r.predicted == y for r in rows if r[label] == y] for y in (0, 1)}
    return [sum(r) / len(r) for r in right.values()]


def test_held_out_toxicity(spark):
    clean, toxic = accuracy(spark, queries.op1_toxicity(spark, SF_DIR), "toxic")
    assert clean > 0.95 and toxic > 0.6  # 400 labelled texts only


def test_held_out_quality(spark):
    bad, good = accuracy(spark, queries.op10_line_crf(spark, SF_DIR), "quality")
    assert bad > 0.85 and good > 0.95


def test_no_labels_give_a_constant_score(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    tox = toxicity.fit(spark, docs, labels, F.lit(True))
    line = line_crf.fit(spark, docs, labels, F.lit(True))
    assert toxicity.score(docs, tox).select("score").distinct().count() == 1
    assert line_crf.score(docs, line).select("score").distinct().count() == 1


def test_sample_is_bounded_and_distinct(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.col("doc_id") > 2, {0: 4, 1: 6}).collect()
    assert sum(r.label == 0 for r in got) <= 4 and sum(r.label == 1 for r in got) <= 6
    assert len({(r.text, r.label) for r in got}) == len(got) and min(r.key for r in got) > 2


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(4)
    model = line_crf.Model(rng.normal(size=3 * line_crf.MEASURES), rng.normal(size=(2, 2)))
    own = rng.normal(size=(6, line_crf.MEASURES))
    first = np.arange(6) == 0
    unary = line_crf._with_neighbours(own, first) @ model.weights
    mass, good = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        p = math.exp(sum(u for u, b in zip(unary, y) if b) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
        mass += p
        good += p * (1 - np.array(y))
    assert np.allclose(model.good(own), good / mass)
    held = np.ones((1, 6), bool)
    bad, pairs, _ = line_crf._chain(unary, model.moves, np.arange(6)[None], held)
    assert np.allclose(1 - bad, good / mass) and math.isclose(pairs.sum(), 5)


def test_quality_on_awkward_rows(spark):
    docs = cases.table(spark)
    model = line_crf.Model(np.linspace(-1, 1, 3 * line_crf.MEASURES), np.eye(2), 1.0, 0.5)
    rows = line_crf.score(cases.clashing(spark, docs), model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2]
    least = sorted(by.values())[len(by) // 2]
    kept = line_crf.kept(docs, model, least)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, s in by.items() if i and s >= least}
    assert line_crf.kept(docs.limit(0), model).count() == 0


def brute_nearest(rows, k):
    use = {i: np.array(v, np.float32).astype(float) for i, v in rows
           if i is not None and v is not None and len(v) == 4 and None not in v
           and all(map(math.isfinite, v)) and any(v)}
    return {q: sorted(((-float(x @ use[q]), i) for i, x in use.items() if i != q))[:k] for q in use if q % 20 == 0}


@pytest.mark.parametrize("n", [0, 1, 3, 300])
def test_nearest_on_awkward_vectors(spark, n, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    rng = random.Random(n)
    rows = [(i * 20 if i % 3 == 0 else i * 20 + 1, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(4)]) for i in range(n)]
    if n > 3:
        rows += [(40_000 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(60)]
        rows += [(7, None), (9, [0.0] * 4), (11, [1.0, None, 2.0, 3.0]), (13, [float("nan")] * 4),
                 (15, [1.0] * 3), (17, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = {}
    for r in ann.nearest(spark, table, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = {q: best for q, best in brute_nearest(rows, 5).items() if best}
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, len(best) + 1))
        listed = [got[q][r] for r in sorted(got[q])]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in listed]
        hits += len({i for i, _ in listed} & {i for _, i in best})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_repeated_ids_and_double_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(0, [9.0] * 4), (1, [8.0] * 4), (1, rows[1][1]), rows[2]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = {}
    for i, v in rows:
        use[i] = min(use.get(i, v), v)
    for r in ann.nearest(spark, table, F.col("vec_id") % 20 == 0, 5).collect():
        assert abs(r.score - sum(a * b for a, b in zip(use[r.query_id], use[r.vec_id]))) < 1e-12
    found = ann.nearest(spark, table, F.col("vec_id") % 20 == 0, 5).groupBy("query_id").agg(
        F.collect_set("rank").alias("r"), F.count("*").alias("n"), F.count_distinct("vec_id").alias("d")).collect()
    assert len(found) == 3 and all(sorted(r.r) == [1, 2, 3, 4, 5] and r.n == r.d == 5 for r in found)


def test_recall(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = queries.op9_multi_index_hashing(spark, SF_DIR).toPandas()
    hits = total = 0
    for q, mine in found.groupby("query_id"):
        near = x @ x[ids == q][0]
        near[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-near)[:20]]) & set(mine.vec_id))
        total += 20
    assert hits / total >= 0.9


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[1:60] = codes[0] ^ (rng.integers(0, 1 << 16, (59, 4), dtype=np.uint16) & rng.integers(0, 1 << 16, (59, 4), dtype=np.uint16)
                              & rng.integers(0, 1 << 16, (59, 4), dtype=np.uint16))
    index = ann.Index(codes)
    for radius in (0, 5, 9, 14, 40):
        for code in codes[:70]:
            assert index.within(code, radius).tolist() == np.flatnonzero(ann.distances(codes, code) <= radius).tolist()


def test_weights_of_stems_that_only_toxic_texts_hold():
    word = "abcdefghijkl"
    counted = {n: (4000, 0) for n in toxicity.nodes(word)}
    found = toxicity._weights(counted, 4000, 16000)
    assert set(found) == set(toxicity.nodes(word))
    assert all(math.isfinite(score) and score > 0 for score, _ in found.values())


def test_one_long_document_among_short_ones(monkeypatch):
    """The longest documents are not padded to the longest one, and pieces give the same sums."""
    rng = np.random.default_rng(7)
    for steps in (2, 7, 16, 61):
        held = np.arange(steps) < np.array([1, steps // 2 + 1, steps])[:, None]
        where = np.where(held, np.arange(3)[:, None] * steps + np.arange(steps), 0)
        unary, moves = rng.normal(0, 2, 3 * steps), rng.normal(0, 1, (2, 2))
        plain = line_crf._chain(unary, moves, where, held)
        for a, b in zip(plain, line_crf._long_chain(unary, moves, where, held)):
            assert np.allclose(a, b, atol=1e-9)
    sizes, chain = [], line_crf._chain
    monkeypatch.setattr(line_crf, "_chain", lambda *a: (sizes.append(a[2].size), chain(*a))[1])
    monkeypatch.setattr(line_crf, "ROUNDS", 1)
    monkeypatch.setattr(line_crf, "STEPS", 1)
    count = [5] * 399 + [100_000]
    own = [rng.normal(0, 1, (n, line_crf.MEASURES)) for n in count]
    line_crf._fit_chain(own, np.arange(400) % 2.0)
    assert max(sizes) <= 1 << 19


def test_sampled_lines_are_bounded(spark, monkeypatch):
    """Whole texts in a fixed order up to the bound, without those of more than a tenth of it."""
    texts = [(i, "\n".join(f"{'plain words here' if i % 2 else '## $$ x'} {i} {j}" for j in range(n)))
             for i, n in enumerate([3, 8, 5, 30, 9, 4, 200, 7, 6, 10, 8, 9, 2, 40, 6, 9, 7, 8])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(line_crf, "_fit_chain", lambda own, y: seen.append(
        [len(x) for x in own]) or line_crf.Model(np.zeros(3 * line_crf.MEASURES), np.zeros((2, 2))))
    for most, lines in ((100, None), (10_000, sum(t.count("\n") + 1 for _, t in texts))):
        line_crf.fit(spark, docs, labels, F.lit(True), most=most)
        counts = seen.pop()
        assert max(counts) <= most / 10
        assert sum(counts) == lines if lines else 60 < sum(counts) <= most
