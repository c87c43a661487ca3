"""Classifier tables: worked examples and brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import evaluation as E
from turnloom.operators import features as X
from turnloom.operators.ordered import Ordering


@pytest.mark.parametrize("segment", [None, 1, 4])
def test_label_expansion_example(spark, segment):
    labels = [0, 0, 0, 1, 1, 0, 0, 0, 1, 0]
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(labels)], "source_file string, pos long, label int")
    order = Ordering(segment_rows=segment)
    ahead = X.expand_labels(frame, order, "label", 2, 0).orderBy("pos").collect()
    assert [r.expanded for r in ahead] == [0, 1, 1, 1, 1, 0, 1, 1, 1, 0]
    behind = X.expand_labels(frame, order, "label", 0, 1).orderBy("pos").collect()
    assert [r.expanded for r in behind] == [0, 0, 0, 1, 1, 1, 0, 0, 1, 1]


@pytest.mark.parametrize("segment,range_rows", [(None, 1 << 18), (7, 3)])
def test_loss_mask_keeps_positives_and_an_exact_quota(spark, segment, range_rows):
    rng = random.Random(6)
    data = {s: [int(rng.random() < 0.3) for _ in range(n)] for s, n in (("a", 97), ("b", 4), ("c", 1))}
    frame = spark.createDataFrame(
        [(s, i, x) for s, xs in data.items() for i, x in enumerate(xs)], "source_file string, pos long, label int")
    rows = X.loss_mask(frame, Ordering(segment_rows=segment), "label", 0.2, 42, range_rows).collect()
    for s, xs in data.items():
        negatives = sorted(
            (i for i, x in enumerate(xs) if x == 0),
            key=lambda i: hashlib.md5(f"42:{s}:{i}".encode()).hexdigest())
        quota = max(1, int(len(negatives) * 0.2))
        expected = {i for i, x in enumerate(xs) if x == 1} | set(negatives[:quota])
        assert {r.pos for r in rows if r.source_file == s and r.in_loss} == expected


def test_vocabulary_order_and_unknown_tokens(spark):
    frame = spark.createDataFrame(
        [("b", 0, "S1", "x", "x", 1), ("a", 1, "Therapist", "y", "y", 0), ("a", 0, "Therapist", "x", "x", None)],
        "source_file string, pos long, speaker string, proc_da string, da_group string, patient_important int",
    ).withColumn("ts_norm", F.lit(None).cast("double"))
    vocab = X.vocabulary(frame, X.token("groups"))
    assert {r.token: r.idx for r in vocab.collect()} == {"therapist::x": 2, "therapist::y": 3, "patient::x": 4}
    encoded = X.encode(frame, X.token("groups"), vocab.filter("idx < 4"), "patient").collect()
    assert {(r.source_file, r.pos): (r.token_id, r.speaker_channel, r.ts, r.label) for r in encoded} == {
        ("a", 0): (2, 0.0, 0.0, 0), ("a", 1): (3, 0.0, 0.0, 0), ("b", 0): (1, 1.0, 0.0, 1)}


@pytest.mark.parametrize("segment", [None, 1, 2])
def test_time_normalisation(spark, segment):
    frame = spark.createDataFrame(
        [("a", 0, 10.0), ("a", 1, None), ("a", 2, 30.0), ("b", 0, 5.0), ("b", 1, 5.0), ("c", 0, None)],
        "source_file string, pos long, seconds double")
    got = {(r.source_file, r.pos): r.ts_norm for r in X.normalise_time(frame, Ordering(segment_rows=segment), "seconds").collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 0.5, ("a", 2): 1.0, ("b", 0): 0.5, ("b", 1): 0.5, ("c", 0): None}


def test_prompt_layout(spark):
    frame = spark.createDataFrame(
        [("f", i, "Therapist" if i % 2 else "S1", "hedge", f" t{i} ") for i in range(3)],
        "source_file string, pos long, speaker string, da_group string, spoken_text string",
    ).withColumn("proc_da", F.col("da_group"))
    rows = X.context_window(frame, Ordering(segment_rows=1), "groups", 2)
    prompt = {r.pos: r.prompt for r in X.prompts(rows, ["EXAMPLE"]).collect()}[0]
    assert prompt == "\n".join([
        X.EXAMPLES_INTRO, "Example 1:", "EXAMPLE", "Classification: important\n", X.TASK,
        "[Preceding context]", "[START OF TRANSCRIPT]", "[START OF TRANSCRIPT]",
        "[TARGET DA — classify this one]", '>>> Patient: [hedge] "t0"',
        "[Following context]", 'Therapist: [hedge] "t1"', 'Patient: [hedge] "t2"', "\nClassification:"])


@pytest.mark.parametrize("text,expected", [
    ("Not important", (0, True)), (" IMPORTANT.", (1, True)), ("it is not important at all", (0, True)),
    ("unimportant", (1, True)), ("no idea", (0, False)), ("", (0, False)),
])
def test_response_parsing(spark, text, expected):
    pred, parsed = E.parse_response(F.col("r"))
    row = spark.createDataFrame([(text,)], "r string").select(pred.alias("p"), parsed.alias("k")).first()
    assert (row.p, row.k) == expected


@pytest.mark.parametrize("truth,pred", [
    ([1, 1, 0, 0, 0], [1, 0, 0, 1, 0]), ([0, 0], [0, 0]), ([1, 1], [1, 1]), ([1, 0], [0, 1]), ([0, 0], [1, 1]),
])
def test_metrics(spark, truth, pred):
    frame = spark.createDataFrame(list(zip(truth, pred)), "label int, pred int")
    row = E.evaluate(frame, "label", "pred").first()

    def f1(cls):
        tp = sum(t == p == cls for t, p in zip(truth, pred))
        wrong = sum((t == cls) != (p == cls) for t, p in zip(truth, pred))
        return 2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0

    classes = sorted(set(truth) | set(pred))
    assert row.f1_important == pytest.approx(f1(1))
    assert row.f1_macro == pytest.approx(sum(map(f1, classes)) / len(classes))
    assert row.f1_weighted == pytest.approx(sum(f1(c) * truth.count(c) for c in classes) / len(truth))


def test_folds_leave_their_own_transcript_out(spark):
    data = {"a": [1, 0, 0], "b": [0, 0], "c": [1]}
    frame = spark.createDataFrame([(s, x) for s, xs in data.items() for x in xs], "source_file string, label int")
    for r in X.fold_table(frame, "label", 2.0).collect():
        train = [x for s, xs in data.items() if s != r.fold for x in xs]
        assert (r.n_train, r.n_train_pos) == (len(train), sum(train))
        assert r.pos_weight == pytest.approx((len(train) - sum(train)) / max(sum(train), 1) * 2.0)


def test_grid_and_ranking(spark):
    points = X.grid(spark, p_a=[1, 2], p_b=[0.1, 0.2, 0.3])
    assert points.count() == 6
    scored = points.withColumns({"mean_fold_f1_imp": F.col("p_a") * 0.1, "std_fold_f1_imp": F.col("p_b")})
    best = E.rank_grid(scored, 2).collect()
    assert [(r.p_a, r.p_b) for r in best] == [(2, 0.1), (2, 0.2)]
    assert X.receptive_field(3, 5) == 13


def _context_rows(spark, files, rows_each, seed=9):
    rng, rows = random.Random(seed), []
    for s in range(files):
        labels = [rng.choice("abc") for _ in range(rows_each if s else 1)]
        rows += [(f"f{s}", i, rng.choice(["S1", "Therapist"]), x, x, int(i > 0 and labels[i - 1] == "a")) for i, x in enumerate(labels)]
    return rows, spark.createDataFrame(
        rows, "source_file string, pos long, speaker string, proc_da string, da_group string, label int")


@pytest.mark.parametrize("segment", [None, 1, 16])
def test_scores_are_those_of_counts_over_the_other_transcripts(spark, segment):
    rows, frame = _context_rows(spark, 5, 12)
    reach, smoothing = 2, (0.5, 2.0)
    text = {(f, p): f"{'therapist' if sp == 'Therapist' else 'patient'}::{g}" for f, p, sp, _, g, _ in rows}
    label = {(f, p): y for f, p, *_, y in rows}
    at = lambda f, p: text.get((f, p), "<start>" if p < 0 else "<end>")
    vocabulary = len(set(text.values())) + 1
    got = X.context_scores(frame, Ordering(segment_rows=segment), X.token("groups"), "label", reach, smoothing).collect()
    assert {(r.source_file, r.pos, r.label) for r in got} == {(f, p, y) for (f, p), y in label.items()}
    for r in got:
        others = [k for k in label if k[0] != r.source_file]
        n1 = sum(label[k] for k in others)
        for s in r.scores:
            want = 0.0
            for o in range(-s.reach, s.reach + 1):
                same = [k for k in others if at(k[0], k[1] + o) == at(r.source_file, r.pos + o)]
                c1 = sum(label[k] for k in same)
                want += math.log((c1 + s.smoothing) / (n1 + s.smoothing * vocabulary))
                want -= math.log((len(same) - c1 + s.smoothing) / (len(others) - n1 + s.smoothing * vocabulary))
            assert s.score == pytest.approx(want)
        assert [(s.smoothing, s.reach) for s in r.scores] == [(a, k) for a in smoothing for k in range(reach + 1)]


def test_the_model_learns_from_context(spark):
    rows, frame = _context_rows(spark, 30, 40)
    scored = X.context_scores(frame, Ordering(segment_rows=16), X.token("groups"), "label", 2)
    prob = X.probability(F.element_at("scores", -1).score)
    result = E.evaluate(scored.withColumn("pred", E.threshold(prob, 0.5)), "label", "pred").first()
    assert scored.count() == len(rows)
    assert result.f1_important > 0.95
    # with the row alone there is nothing to learn from
    alone = E.evaluate(scored.withColumn("pred", E.threshold(X.probability(F.col("scores")[0].score, 2.0), 0.5)), "label", "pred").first()
    assert alone.f1_important < 0.9


def test_pooled_metrics_come_from_the_folds(spark):
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(6)}", rng.randrange(2), rng.randrange(2), rng.choice("xy")) for _ in range(200)]
    frame = spark.createDataFrame(rows, "source_file string, label int, pred int, p_a string")
    folds = E.fold_metrics(frame, "p_a").toPandas()
    for r in E.pooled_metrics(frame, "p_a").collect():
        own = folds[folds.p_a == r.p_a]
        assert r.mean_fold_f1_imp == pytest.approx(own.f1_important.mean())
        assert r.std_fold_f1_imp == pytest.approx(own.f1_important.std(ddof=0))
        whole = E.evaluate(frame.filter(F.col("p_a") == r.p_a), "label", "pred").first()
        assert (r.pooled_f1_imp, r.pooled_f1_weighted) == (pytest.approx(whole.f1_important), pytest.approx(whole.f1_weighted))
