"""Blocks, context and sequences against brute force on random transcripts."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import blocks as B
from turnloom.operators import ngrams as N
from turnloom.operators import responses as R
from turnloom.operators.ordered import Ordering

LABELS = ["Statement-opinion", "Statement-non-opinion", "Hedge", "Wh-Question", "Yes-answers"]
SEGMENTS = [None, 1, 3, 10]


def transcripts():
    rng = random.Random(5)
    out = {}
    for name, n in (("T1_with_a.csv", 40), ("T2_with_b.csv", 1), ("T3_with_c.csv", 17), ("T4_with_d.csv", 90)):
        flag = 0
        rows = []
        for pos in range(n):
            flag = 1 - flag if rng.random() < 0.3 else flag
            rows.append({
                "pos": pos, "proc_da": rng.choice(LABELS),
                "patient_important": flag, "therapist_important": int(rng.random() < 0.2),
                "patient_code": rng.choice([None, "", "A, B", "B", " C ,nan,A"]) if flag else None,
                "therapist_code": None, "speaker": rng.choice(["Therapist", "S1"]),
            })
        out[name] = rows
    return out


DATA = transcripts()


@pytest.fixture(scope="module", params=SEGMENTS)
def hub(request, spark):
    order = Ordering(segment_rows=request.param)
    flat = [
        (name, r["pos"], r["proc_da"], r["patient_important"], r["therapist_important"],
         r["patient_code"], r["therapist_code"], r["speaker"])
        for name, rows in DATA.items() for r in rows
    ]
    frame = spark.createDataFrame(
        flat, "source_file string, pos long, proc_da string, patient_important int, therapist_important int, "
        "patient_code string, therapist_code string, speaker string",
    ).withColumn("da_group", L.extended_group(F.col("proc_da")))
    return B.index_islands(frame, order), order


def runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def groups_of(rows):
    inverse = L.members(L.EXTENDED_GROUPS)
    return [inverse.get(r["proc_da"], "other") for r in rows]


def test_blocks_and_codes(hub):
    table, _ = hub
    got = {(r.source_file, r.block_start): (r.block_end, r.n_rows, r.codes)
           for r in B.block_table(table, "patient").collect()}
    expected = {}
    for name, rows in DATA.items():
        for s, e in runs([r["patient_important"] == 1 for r in rows]):
            codes = []
            for r in rows[s:e + 1]:
                cell = [c.strip() for c in str(r["patient_code"]).split(",")]
                for c in [c for c in cell if c not in L.EMPTY_CODES] or ["NA"]:
                    if c not in codes:
                        codes.append(c)
            expected[name, s] = (e, e - s + 1, codes)
    assert got == expected


def test_codes_that_ignore_empty_cells(hub):
    table, _ = hub
    got = {(r.source_file, r.block_start): r.codes
           for r in B.block_table(table, "patient", skip_null=True).collect()}
    for name, rows in DATA.items():
        for s, e in runs([r["patient_important"] == 1 for r in rows]):
            codes = []
            for r in rows[s:e + 1]:
                if r["patient_code"] is None:
                    continue
                cell = [c.strip() for c in r["patient_code"].split(",")]
                for c in [c for c in cell if c not in L.EMPTY_CODES] or ["NA"]:
                    if c not in codes:
                        codes.append(c)
            assert got[name, s] == (codes or ["NA"])


@pytest.mark.parametrize("context", [0, 1, 4, 15])
def test_context_rows(hub, context):
    table, order = hub
    got = {(r.source_file, r.block_start, r.region, r.pos, r.region_start)
           for r in B.context_rows(table, order, "patient", context).collect()}
    expected = set()
    for name, rows in DATA.items():
        n = len(rows)
        for s, e in runs([r["patient_important"] == 1 for r in rows]):
            first = max(0, s - context)
            expected |= {(name, s, "pre", p, first) for p in range(first, s)}
            expected |= {(name, s, "core", p, s) for p in range(s, e + 1)}
            expected |= {(name, s, "post", p, e + 1) for p in range(e + 1, min(n, e + 1 + context))}
    assert got == expected


@pytest.mark.parametrize("context", [0, 2, 5])
def test_unclaimed_sequences(hub, context):
    table, order = hub
    got = {(r.source_file, r.pos, r.free_start, r.free_end)
           for r in B.unclaimed(table, order, context).collect()}
    expected = set()
    for name, rows in DATA.items():
        claimed = [False] * len(rows)
        for column in ("patient_important", "therapist_important"):
            for s, e in runs([r[column] == 1 for r in rows]):
                for p in range(max(0, s - context), min(len(rows), e + 1 + context)):
                    claimed[p] = True
        for s, e in runs([not c for c in claimed]):
            expected |= {(name, p, s, e) for p in range(s, e + 1)}
    assert got == expected


def test_blocks_and_rest_cover_the_transcript(hub):
    table, _ = hub
    important = B.sequence_rows(table, "either").count()
    assert important + B.sequence_rows(table, "neither").count() == sum(map(len, DATA.values()))


def test_clamped_chunks_do_not_enter_the_next_block(hub):
    table, order = hub
    got = {(r.source_file, r.block_start): (r.context_start, r.context_end)
           for r in B.clamped_chunks(table, order, 3).collect()}
    for name, rows in DATA.items():
        found = runs([r["patient_important"] == 1 or r["therapist_important"] == 1 for r in rows])
        for i, (s, e) in enumerate(found):
            previous = found[i - 1][1] if i else -1
            following = found[i + 1][0] if i + 1 < len(found) else len(rows)
            assert got[name, s] == (max(previous + 1, s - 3), min(following - 1, e + 3))


def compress(labels):
    return [x for i, x in enumerate(labels) if i == 0 or labels[i - 1] != x]


@pytest.mark.parametrize("kind", ["patient", "neither", "transcript"])
def test_compressed_ngrams(hub, kind):
    table, order = hub
    rows = B.compress_runs(B.sequence_rows(table, kind), "groups").withColumn("label", F.col("da_group"))
    got = {(r.n, r.ngram): r.cnt for r in N.count_ngrams(N.ngrams(rows, order, (1, 2, 4))).collect()}
    expected = {}
    for rows in DATA.values():
        labels = groups_of(rows)
        important = [r["patient_important"] == 1 for r in rows]
        neither = [not (r["patient_important"] or r["therapist_important"]) for r in rows]
        spans = {"patient": runs(important), "neither": runs(neither),
                 "transcript": [(0, len(rows) - 1)]}[kind]
        for s, e in spans:
            short = compress(labels[s:e + 1])
            for n in (1, 2, 4):
                for i in range(len(short) - n + 1):
                    key = (n, " -> ".join(short[i:i + n]))
                    expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_worked_compression_example(spark):
    """ST ST HG HG Q compresses to ST HG Q."""
    rows = [("f", i, x, x, 1, 0, None, None, "p") for i, x in enumerate(
        ["Statement-opinion"] * 2 + ["Hedge"] * 2 + ["Wh-Question"])]
    frame = spark.createDataFrame(
        rows, "source_file string, pos long, proc_da string, da_group string, patient_important int, "
        "therapist_important int, patient_code string, therapist_code string, speaker string")
    table = B.index_islands(frame, Ordering())
    short = B.compress_runs(B.sequence_rows(table, "patient"), "raw").orderBy("pos")
    assert [(r.proc_da, r.run_length) for r in short.collect()] == [
        ("Statement-opinion", 2), ("Hedge", 2), ("Wh-Question", 1)]


@pytest.mark.parametrize("size", [None, 1, 3])
def test_rest_windows(hub, size):
    table, _ = hub
    got = {(r.source_file, r.seq, r.pos) for r in B.rest_windows(table, "patient", size).collect()}
    expected = set()
    for name, rows in DATA.items():
        for s, e in runs([r["patient_important"] == 0 for r in rows]):
            if size is None:
                expected |= {(name, s, p) for p in range(s, e + 1)}
            else:
                for first in range(s, e + 2 - size, size):
                    expected |= {(name, first, p) for p in range(first, first + size)}
    assert got == expected


def test_question_response_patterns(hub):
    table, order = hub
    got = {(r.source_file, r.pos): (r.is_pattern_question, r.is_pattern_response, r.pattern_id)
           for r in R.label_patterns(table, order).collect()}
    inverse = L.members(L.CORE_GROUPS)
    for name, rows in DATA.items():
        groups = [inverse.get(r["proc_da"]) for r in rows]
        expected = [(False, False, None)] * len(rows)
        number, i = 0, 0
        while i < len(groups):
            j = i + 1
            if groups[i] in L.QUESTION_GROUPS:
                while j < len(groups) and groups[j] in L.RESPONSE_GROUPS:
                    j += 1
                if j > i + 1:
                    expected[i] = (True, False, number)
                    expected[i + 1:j] = [(False, True, number)] * (j - i - 1)
                    number += 1
            i = j
        assert [got[name, p] for p in range(len(rows))] == expected
