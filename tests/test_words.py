"""Words: the golden example, packing, alignment and collapse."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import words as W
from turnloom.operators.ordered import Ordering
from turnloom.session import write_table

TURNS = [
    ("S1", "0:00", 0, 0, "Hello, how are you doing today?"),
    ("Therapist", "0:05", 1, 0, "I am good. What should we talk about today?"),
    ("S1", "0:08", 0, 1, "I think talking about classes would be the most helpful."),
]
OPEN, WH, NON, OPI = "Conventional-opening", "Wh-Question", "Statement-non-opinion", "Statement-opinion"
# word, label, score, label after back-fill, score of that label, segment
GOLDEN = [
    ("Hello,", OPEN, 0.976962, OPEN, 0.976962, 0),
    ("how", "I-", 0.9648734, OPEN, 0.9227433, 1), ("are", "I-", 0.9948302, OPEN, 0.9227433, 1),
    ("you", "I-", 0.9819505, OPEN, 0.9227433, 1), ("doing", "I-", 0.6529126, OPEN, 0.9227433, 1),
    ("today?", OPEN, 0.9227433, OPEN, 0.9227433, 1),
    ("I", "I-", 0.9869168, OPEN, 0.7974084, 2), ("am", "I-", 0.939946, OPEN, 0.7974084, 2),
    ("good.", OPEN, 0.7974084, OPEN, 0.7974084, 2),
    ("What", "I-", 0.9908654, WH, 0.8939524, 3), ("should", "I-", 0.9976041, WH, 0.8939524, 3),
    ("we", "I-", 0.9987186, WH, 0.8939524, 3), ("talk", "I-", 0.9986534, WH, 0.8939524, 3),
    ("about", "I-", 0.93283516, WH, 0.8939524, 3), ("today?", WH, 0.8939524, WH, 0.8939524, 3),
    ("I", "I-", 0.9988166, NON, 0.5032249, 4), ("think", "I-", 0.99904627, NON, 0.5032249, 4),
    ("talking", "I-", 0.9994073, NON, 0.5032249, 4), ("about", "I-", 0.99911755, NON, 0.5032249, 4),
    ("classes", NON, 0.5032249, NON, 0.5032249, 4),
    ("would", "I-", 0.99400526, OPI, 0.7240815, 5), ("be", "I-", 0.99241066, OPI, 0.7240815, 5),
    ("the", "I-", 0.9932287, OPI, 0.7240815, 5), ("most", "I-", 0.9709343, OPI, 0.7240815, 5),
    ("helpful.", OPI, 0.7240815, OPI, 0.7240815, 5),
]


def golden_scorer():
    """Replays the labels of the example, in order."""
    labels = [(label, score) for _, label, score, *_ in GOLDEN]

    def score(texts):
        (text,) = texts
        return [[{"word": "Ġ" + w, "entity": e, "score": s} for w, (e, s) in zip(text.split(" "), labels)]]

    return score


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(
        [("example.csv", i, *t) for i, t in enumerate(TURNS)],
        "source_file string, turn long, speaker string, timestamp string, patient_important int, "
        "therapist_important int, spoken_text string",
    ).withColumns({"patient_code": F.lit(None).cast("string"), "therapist_code": F.lit(None).cast("string")})


@pytest.mark.parametrize("segment", [None, 1, 2, 4, 100])
def test_golden_example_end_to_end(turns, segment):
    order = Ordering(segment_rows=segment)
    words = W.turn_words(W.clean_turns(turns), order.by("turn"))
    windows = W.window_texts(W.assign_windows(words, order))
    scored = W.attach_scores(words, W.score_words(windows, golden_scorer))
    done = W.back_fill(W.number_segments(scored, order), order)
    got = [
        (r.spoken_text, r.pred_da, r.raw_score, r.proc_da, r.score, r.da_number)
        for r in done.orderBy("pos").collect()
    ]
    assert got == GOLDEN
    acts = W.collapse(done, order).orderBy("pos").collect()
    assert [(a.pos, a.speaker, a.proc_da, a.spoken_text) for a in acts] == [
        (0, "S1", OPEN, "Hello,"), (1, "S1", OPEN, "how are you doing today?"),
        (2, "Therapist", OPEN, "I am good."), (3, "Therapist", WH, "What should we talk about today?"),
        (4, "S1", NON, "I think talking about classes"), (5, "S1", OPI, "would be the most helpful."),
    ]
    assert [(a.patient_important, a.therapist_important, a.timestamp) for a in acts][2:5] == [
        (1, 0, "0:05"), (1, 0, "0:05"), (0, 1, "0:08")]
    done = write_table(turns.sparkSession, "done", done)
    bare = write_table(turns.sparkSession, "acts", W.collapse(done, order, texts=False))
    assert "spoken_text" not in bare.columns
    for piece_words in (1, 2, 100):
        texts = {}
        for r in W.act_texts(done, bare, piece_words).orderBy("piece").collect():
            assert len(r.spoken_text.split()) <= piece_words
            texts.setdefault(r.da_number, []).append(r.spoken_text)
        assert {n: " ".join(t) for n, t in texts.items()} == {a.da_number: a.spoken_text for a in acts}


def test_older_layout_example(spark):
    """Labels of the older example back-fill and its segments number alike, one higher."""
    O, S = "Open-Question", "Statement-non-opinion"
    rows = [
        ("Hello", OPEN, OPEN, 1), ("how", "I-", O, 2), ("are", "I-", O, 2), ("you", "I-", O, 2),
        ("today", O, O, 2), ("?", O, O, 2), ("I", "I-", S, 3), ("am", "I-", S, 3), ("ok", "I-", S, 3),
        ("today", S, S, 3), (",", "I-", O, 3), ("how", "I-", O, 4), ("are", "I-", O, 4), ("you", O, O, 4), ("?", O, O, 4),
    ]
    frame = spark.createDataFrame(
        [("f", i, label, 0.5) for i, (_, label, _, _) in enumerate(rows)],
        "source_file string, pos long, pred_da string, raw_score double")
    done = W.back_fill(W.number_segments(frame, Ordering()), Ordering()).orderBy("pos").collect()
    assert [r.proc_da for r in done] == [filled for _, _, filled, _ in rows]
    numbers = [r.da_number for r in done]
    assert numbers[:10] == [n - 1 for *_, n in rows[:10]]
    assert numbers[11:] == [n - 1 for *_, n in rows[11:]]


def greedy(words, limit):
    windows, current, length = [], [], 0
    number, out = 0, []
    for word in words:
        if length + len(word) + 1 > limit:
            number, length = number + 1, len(word)
        else:
            length += len(word) + 1
        out.append(number)
    return out


@pytest.mark.parametrize("segment", [None, 1, 2, 5, 50])
@pytest.mark.parametrize("limit", [6, 20, 64])
def test_packing_equals_greedy(spark, segment, limit):
    rng = random.Random(limit)
    texts = {
        name: ["w" * rng.choice([0, 1, 2, 3, 5, 9, limit - 1, limit, limit + 1, limit + 7]) if rng.random() < 0.3
               else "w" * rng.randint(0, 4) for _ in range(n)]
        for name, n in (("a", 120), ("b", 1), ("c", 33))
    }
    frame = spark.createDataFrame(
        [(s, i, w) for s, words in texts.items() for i, w in enumerate(words)],
        "source_file string, pos long, scrubbed string")
    got = {(r.source_file, r.pos): r.window for r in W.assign_windows(
        frame, Ordering(segment_rows=segment), max_length=limit).collect()}
    for s, words in texts.items():
        assert [got[s, i] for i in range(len(words))] == greedy(words, limit)


def test_alignment_by_word_endings():
    tokens = [{"word": w, "entity": e, "score": 1.0} for w, e in (
        ("Ġtalk", "A"), ("ing", "I-"), (" ", "X"), ("Ġto", "B"), ("Ġyou", "C"), ("Ċ", "D"))]
    found = W.align(["talking", "to", "", "you", "x", "late"], tokens)
    assert [None if f is None else [t["word"] for t in f] for f in found] == [
        ["talk", "ing"], ["to"], None, ["you"], ["Ċ"], None]
    assert W.align(["a"], []) == [None]


def test_token_and_word_cleaning(spark):
    assert W.clean_token(" ĠhiÄŠ\n") == "hi"
    assert W.clean_token("â€œquoted") == "œquoted"
    row = spark.createDataFrame([("dé—jà\nvu â€™s",)], "w string").select(W.scrub(F.col("w")).alias("s")).first()
    assert row.s == "djvus"


def test_cleaning_turns(spark):
    frame = spark.createDataFrame(
        [("f", 0, "a-b—c–d"), ("f", 1, "  \n"), ("f", 2, None), ("f", 3, "â€”"), ("f", 4, "ok")],
        "source_file string, turn long, spoken_text string")
    got = [(r.turn, r.spoken_text) for r in W.clean_turns(frame).orderBy("turn").collect()]
    assert got == [(0, "a b c d"), (4, "ok")]


def test_unlabelled_words_take_no_number_and_count(spark):
    labels = ["A", None, "I-", "B", None, None, "I-"]
    frame = spark.createDataFrame(
        [("f", i, x, 0.1 * i) for i, x in enumerate(labels)],
        "source_file string, pos long, pred_da string, raw_score double")
    for segment in (None, 1, 3):
        order = Ordering(segment_rows=segment)
        rows = W.back_fill(W.number_segments(frame, order), order).orderBy("pos").collect()
        # A; +1 unlabelled; I- after A +1; B after I- stays; +2 unlabelled; I- after B +1
        assert [r.da_number for r in rows] == [0, None, 2, 2, None, None, 5]
        assert [r.proc_da for r in rows] == ["A", None, "B", "B", None, None, "I-"]


@pytest.mark.parametrize("pieces", [1, 3, 100])
def test_texts_of_any_length_come_in_pieces(spark, pieces):
    rng, rows = random.Random(pieces), []
    for name, n in (("f", 23), ("g", 1)):
        rows += [(name, i, rng.choice(["S1", "S2", None]), f"w{i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "source_file string, pos long, speaker string, scrubbed string")
    found = sorted(map(tuple, W.one_window(frame, piece_words=pieces).select("source_file", "piece", "text").collect()))
    assert all(len(t.split()) <= pieces for *_, t in found)
    for name in "fg":
        assert " ".join(t for s, _, t in found if s == name) == " ".join(w for s, _, _, w in rows if s == name)
    for segment in (None, 2, 50):
        turns = W.merge_speaker_turns(frame, Ordering(segment_rows=segment), "scrubbed", pieces).collect()
        got = sorted((r.source_file, r.first_pos, r.piece, r.speaker, r.n_words, r.scrubbed) for r in turns)
        want, speaker = {}, None
        for s, i, said, w in rows:
            speaker = said or (speaker if i else None)
            if not i or speaker != want[last][0]:
                last = (s, i)
                want[last] = (speaker, [])
            want[last][1].append(w)
        assert got == sorted((s, i, k, who, len(ws[k * pieces:(k + 1) * pieces]), " ".join(ws[k * pieces:(k + 1) * pieces]))
                             for (s, i), (who, ws) in want.items() for k in range(-(-len(ws) // pieces)))


def test_whole_text_of_many_pieces_is_one_row(spark):
    rows = [("f", i, "S1" if i < 10 else "S2", f"w{i}") for i in range(23)] + [("g", 0, None, "w0")]
    frame = spark.createDataFrame(rows, "source_file string, pos long, speaker string, scrubbed string")
    found = W.whole(W.one_window(frame, piece_words=2), ["source_file"], "text").collect()
    assert {r.source_file: r.text for r in found} == {
        name: " ".join(w for s, _, _, w in rows if s == name) for name in "fg"} and len(found) == 2
    turns = W.merge_speaker_turns(frame, Ordering(segment_rows=4), "scrubbed", 2)
    got = W.whole(turns, ["source_file", "first_pos"], "scrubbed", F.first("speaker").alias("speaker"),
                  F.sum("n_words").alias("n_words")).select("source_file", "first_pos", "speaker", "n_words", "scrubbed").collect()
    assert sorted(map(tuple, got)) == [
        ("f", 0, "S1", 10, " ".join(f"w{i}" for i in range(10))),
        ("f", 10, "S2", 13, " ".join(f"w{i}" for i in range(10, 23))), ("g", 0, None, 1, "w0")]


def load_memory_scorer():
    """Scores are the largest memory the worker had so far, in kB."""
    import resource

    return lambda texts: [
        [{"word": w, "entity": "x", "score": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss} for w in text.split(" ")]
        for text in texts]


def test_scoring_holds_few_windows_at_once(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct(
        (F.col("id") * 60 + i).alias("pos"), F.concat(F.lit("word"), i.cast("string")).alias("word")))
    windows = spark.range(8000, numPartitions=1).select(
        F.lit("a").alias("source_file"), words.alias("words")).withColumn(
        "text", F.array_join(F.transform("words", lambda w: w["word"]), " "))
    row = W.score_words(windows, load_memory_scorer).agg(
        F.count("*"), F.countDistinct("pos"), F.max("raw_score") - F.min("raw_score")).first()
    assert row[0] == row[1] == 8000 * 60
    assert row[2] < 40 << 10
