"""Exact substring removal against brute force."""

import random

import numpy as np
import pytest

from tests.llm import cases
from turnloom.llm import runs, suffix_dedup


def brute(docs, width):
    """Removed spans of every (key, text): bytes under a string that an earlier key holds."""
    seen = {}
    for key, text in docs:
        if key is not None:
            for i in range(len(text) - width + 1):
                w = text[i:i + width]
                seen[w] = min(key, seen.get(w, key))
    out = []
    for key, text in docs:
        gone = [False] * len(text)
        if key is not None:
            for i in range(len(text) - width + 1):
                if seen[text[i:i + width]] < key:
                    gone[i:i + width] = [True] * width
        edges = [i for i in range(len(text) + 1)
                 if (0 < i <= len(text) and gone[i - 1]) != (i < len(text) and gone[i])]
        out.append((key, len(text), tuple(zip(edges[::2], edges[1::2])),
                    bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept))
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [50, 12, 2])
def test_remove_repeats(spark, width):
    docs = cases.table(spark)
    want = brute([(i, (t or "").encode()) for i, t in cases.texts()], width)
    assert got(suffix_dedup.remove_repeats(spark, docs, width)) == want
    wide = cases.clashing(spark, docs.repartition(3))
    assert got(suffix_dedup.remove_repeats(spark, wide, width, run_bytes=(700, 700))) == want


@pytest.mark.parametrize("run_bytes", [(1 << 18, 1 << 28), (300, 300)])
def test_keys_that_rows_share(spark, run_bytes):
    rows = cases.repeated_keys()
    out = suffix_dedup.remove_repeats(spark, cases.table(spark, rows), run_bytes=run_bytes)
    assert got(out) == brute([(i, (t or "").encode()) for i, t in rows], 50)


def test_random_texts_over_few_letters(spark):
    rng = random.Random(8)
    for width in (5, 9, 30):
        stock = ["".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(12)]
        rows = [(i // 2, "".join(rng.choice(stock) for _ in range(rng.randrange(6)))) for i in range(60)]
        rows += [(100 + i, "\0" * (i + 20)) for i in range(4)] + [(200, "a" * 300), (201, "b" + "a" * 90)]
        want = brute([(i, t.encode()) for i, t in rows], width)
        table = cases.table(spark, rows)
        assert got(suffix_dedup.remove_repeats(spark, table, width, run_bytes=(300, 300))) == want
    assert suffix_dedup.remove_repeats(spark, table.limit(0)).count() == 0


def test_loser_tree_orders_and_counts_shared_bytes():
    rng = random.Random(3)
    for _ in range(200):
        width, parts, every = 6, [], []
        for r in range(rng.randrange(1, 7)):
            rows = sorted(bytes(rng.choice(b"\0ab") for _ in range(width)) for _ in range(rng.randrange(1, 12)))
            shared = [0] + [next((i for i in range(width) if a[i] != b[i]), width) for a, b in zip(rows, rows[1:])]
            rest = b"".join(x[n:] for x, n in zip(rows, shared))
            parts.append((np.array(shared), np.frombuffer(rest, np.uint8)))
            every.append(rows)
        taken, lengths = suffix_dedup.merge_runs(parts, width)
        merged = [every[r][i] for r, i, j in taken]
        assert all(len(set(every[r][i:j])) == 1 for r, i, j in taken)
        assert merged == sorted(merged) and sum(j - i for _, i, j in taken) == sum(map(len, every))
        assert lengths == [0] + [next((i for i in range(width) if a[i] != b[i]), width) for a, b in zip(merged, merged[1:])]


def test_messages_round_trip():
    a, b = np.arange(5, dtype="<i8"), np.zeros(0, "u1")
    x, y = runs.unpack(runs.pack(a, b), "<i8", "u1")
    assert x.tolist() == a.tolist() and not len(y)
    hashes = np.array([0, 1, 2**48 - 1], "<u8")
    assert runs._eight(runs._six(hashes)).tolist() == hashes.tolist()


def test_anchors_are_dealt_evenly():
    """An anchor is the least hash around it; buckets must not go by that, or a few get most entries."""
    rows = [cases.words(2000, 50 + n, 5000).encode() for n in range(20)]
    keys, no = np.arange(20), np.zeros(20, bool)
    found = suffix_dedup._Suffixes(50).anchors(runs.Run(keys, rows, no, no, keys))
    dealt = np.bincount(runs.bucket_of(found.hashes, 16).astype(int), minlength=16)
    assert dealt.max() < 1.5 * dealt.mean()
