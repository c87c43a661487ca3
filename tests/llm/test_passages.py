"""Compact windows and near-duplicate passages against brute force."""

import random

import numpy as np
import pytest

from tests.llm import cases
from turnloom.llm import compact_windows as cw
from turnloom.llm import runs


def words_in(text):
    return (text or "").encode().lower().split()


def brute(docs, words):
    """Word positions of each key that lie in a run of `words` words which an earlier key holds."""
    seen = {}
    for key, text in docs:
        w = words_in(text)
        for i in range(len(w) - words + 1 if key is not None else 0):
            g = tuple(w[i:i + words])
            seen[g] = min(key, seen.get(g, key))
    out = {}
    for key, text in docs:
        w = words_in(text)
        for i in range(len(w) - words + 1 if key is not None else 0):
            if seen[tuple(w[i:i + words])] < key:
                out.setdefault(key, set()).update(range(i, i + words))
    return out


def found(df):
    out, kept = {}, {}
    for r in df.collect():
        kept[r.doc_id] = bytes(r.kept)
        for p in r.passages:
            out.setdefault(r.doc_id, []).append(p)
    return out, kept


def covered(passages):
    return {k: {i for p in ps for i in range(p.start_word, p.end_word)} for k, ps in passages.items()}


@pytest.mark.parametrize("words", [50, 12])
def test_exact_repeats_are_all_found(spark, words):
    docs = cases.table(spark)
    want = brute(cases.texts(), words)
    for table, sizes in ((docs, {}), (cases.clashing(spark, docs.repartition(3)), {"run_bytes": (900, 900)})):
        got, kept = found(cw.find_passages(spark, table, words, **sizes))
        got = {k: v for k, v in got.items() if k is not None}
        for key, positions in want.items():
            assert positions <= covered(got)[key]
        by = dict(t for t in cases.texts() if t[0] is not None)
        for key, ps in got.items():
            assert all(p.end_word - p.start_word >= words for p in ps)
            assert all(s < key for p in ps for s in p.sources)
            left = [w for i, w in enumerate(words_in(by[key])) if i not in covered(got)[key]]
            assert kept[key].lower().split() == left
        assert 10 not in got and 17 not in got
    assert cw.find_passages(spark, docs.limit(0)).count() == 0


def test_near_repeats_and_clean_texts(spark):
    """One word in forty changed, dropped or added; passages inside other text."""
    rng, rows, near = random.Random(4), [], set()
    for n in range(40):
        passage = cases.words(70, 100 + n, 3000).split()
        rows.append((10 * n, cases.words(60, 200 + n, 3000) + " " + " ".join(passage) + "\n" + cases.words(40, 300 + n, 3000)))
        i, how = rng.randrange(2, 68), n % 3
        changed = passage[:i] + [[], ["new"], ["new", passage[i]]][how] + passage[i + 1:]
        rows.append((10 * n + 1, cases.words(30, 400 + n, 3000) + " " + " ".join(changed) + " " + cases.words(50, 500 + n, 3000)))
        near.add(10 * n + 1)
    rows += [(1000 + n, cases.words(150, 900 + n, 3000)) for n in range(40)]
    rows += [(2000 + n, "a line that is very often here with some words " * 2 + cases.words(90, 600 + n, 3000)) for n in range(70)]
    got, _ = found(cw.find_passages(spark, cases.table(spark, rows), run_bytes=(4000, 4000)))
    assert len(near & set(got)) >= 39 and not set(got) - near
    assert all(p.sources == [k - 1] for k, ps in got.items() for p in ps)


def test_edited_copies_of_repeated_verses(spark):
    """A verse said four times, with one word changed in the middle: no 50 words are left as they were."""
    rows, near = [], set()
    for n in range(30):
        verse = cases.words(20, 100 + n, 3000).split() * 4
        rows.append((10 * n, cases.words(60, 200 + n, 3000) + " " + " ".join(verse) + " " + cases.words(40, 300 + n, 3000)))
        verse[40] = "changed"
        rows.append((10 * n + 1, cases.words(30, 400 + n, 3000) + " " + " ".join(verse) + " " + cases.words(50, 500 + n, 3000)))
        near.add(10 * n + 1)
    rows += [(1000 + n, " ".join(cases.words(20, 900 + n, 3000).split() * 4)) for n in range(20)]
    rows += [(2000 + n, "one " * (100 + n)) for n in range(20)]
    assert not {k for k in brute(rows, 50) if k < 2000}
    got, _ = found(cw.find_passages(spark, cases.table(spark, rows), run_bytes=(4000, 4000)))
    one = set(range(2001, 2020))
    assert one <= set(got) and not set(got) - near - one
    assert len(near & set(got)) >= 29
    assert all(p.sources == [k - 1] for k, ps in got.items() for p in ps if k < 2000)


def test_extents_are_the_cartesian_tree():
    rng = random.Random(6)
    for _ in range(100):
        sizes = [rng.randrange(1, 20) for _ in range(3)]
        values = np.array([rng.randrange(6) + 1 for _ in range(sum(sizes))], np.uint64)
        low = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        high = np.repeat(np.cumsum(sizes), sizes)
        left, right = cw.extents(values, np.arange(len(values)), low, high)
        for i in range(len(values)):
            a, b = i, i
            while a > low[i] and values[a - 1] >= values[i]:
                a -= 1
            while b + 1 < high[i] and values[b + 1] >= values[i]:
                b += 1
            assert (left[i], right[i]) == (a, b)


def test_words_and_shingles():
    for _, text in cases.texts():
        body = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends, hashes = cw.words_of(body)
        assert [bytes(body[a:b]).lower() for a, b in zip(starts, ends)] == words_in(text)
        assert len(set(hashes.tolist())) == len(set(words_in(text)))
        w, s = words_in(text), cw.shingles_of(hashes, 5)
        assert len(s) == max(0, len(w) - 4)
        assert len(set(s.tolist())) == len({tuple(w[i:i + 5]) for i in range(len(w) - 4)})


def every_pair(method, code, keys, near):
    """Range and earliest source of each row by verifying all pairs of its group."""
    a, b = method._extent(near)
    y, x = np.tril_indices(len(keys), -1)
    x, y = np.concatenate((x, y)), np.concatenate((y, x))
    use = (code[x] == code[y]) & (keys[x] < keys[y])
    use &= np.minimum(a[x], a[y]) + np.minimum(b[x], b[y]) + 1 >= method.length
    want = [(127, -128, np.iinfo(np.int64).max)] * len(keys)
    for i, j, lo, hi in method._verified(x[use], y[use], near, a, b):
        for x1, y1, l1, h1 in zip(i.tolist(), j.tolist(), lo.tolist(), hi.tolist()):
            l0, h0, k0 = want[y1]
            want[y1] = min(l0, l1), max(h0, h1), min(k0, int(keys[x1]))
    return want


def searched(method, code, keys, near):
    made = method._similar(code, keys, near, *method._extent(near))
    return [tuple(int(v) for v in row) for row in zip(*made)]


def test_large_groups_lose_no_pair():
    rng = np.random.default_rng(5)
    method = cw._Windows(5, 50, 0.8, 3)
    near = rng.integers(1, 1 << 24, (120, 91), dtype=np.uint32)
    near[:, 45] = 7
    near[:, 40:60] = near[0, 40:60]  # a frequent line
    for i in range(60, 90):  # near copies with at most five shingles changed on either side
        near[i] = near[i - 60]
        at = rng.integers(0, 86)
        near[i, at:at + 5] = rng.integers(1, 1 << 24, 5)
    near[90:100, :30] = 0
    code, keys = np.full(120, 3, np.uint64), np.arange(120)
    want = every_pair(method, code, keys, near)
    assert searched(method, code, keys, near) == want and sum(w[0] < 127 for w in want) >= 25


@pytest.mark.parametrize("words,similar", [(50, 0.8), (12, 0.8), (50, 0.5), (20, 1.0), (13, 0.6)])
def test_ranges_equal_those_of_all_pairs(words, similar):
    """Cut, shifted and changed variants of frequent passages, in groups of many sizes with equal keys."""
    method = cw._Windows(5, words, similar, 3)
    wide, reach = 2 * method.reach + 1, method.reach
    for seed in range(6):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, [6, 90, 200][seed % 3], 6)
        n = int(sizes.sum())
        code, near = np.repeat(np.arange(6), sizes).astype(np.uint64), np.zeros((n, wide), np.uint32)
        base = rng.integers(1, 1 << 24, (6, 3, wide), dtype=np.uint32)
        for r in range(n):
            row = base[int(code[r]), rng.integers(3)].copy()
            for _ in range(rng.integers(0, 4)):
                at, size = rng.integers(0, wide), rng.integers(1, 6)
                row[at:at + size] = rng.integers(1, 1 << 24, len(row[at:at + size]))
            shift = rng.integers(0, reach)
            if rng.random() < 0.3:
                row[:shift] = np.roll(row, 1)[:shift]
            if rng.random() < 0.4:
                row[:rng.integers(0, reach + 1)] = rng.integers(1, 1 << 24)
            row[:rng.integers(0, reach + 1) if rng.random() < 0.3 else 0] = 0
            row[wide - (rng.integers(0, reach + 1) if rng.random() < 0.3 else 0):] = 0
            row[reach] = 7
            near[r] = row
        keys = rng.integers(0, max(2, n - n // 8), n)
        want = every_pair(method, code, keys, near)
        assert searched(method, code, keys, near) == want


def test_variants_that_share_too_little_are_not_compared():
    """Many edited copies of a passage: bitmaps tell most pairs apart, so few are compared shingle by shingle."""
    rng, method = np.random.default_rng(9), cw._Windows(5, 50, 0.8, 3)
    n, wide = 400, 2 * method.reach + 1
    near = np.repeat(rng.integers(1, 1 << 24, (1, wide), dtype=np.uint32), n, 0)
    for row in near:
        for at in rng.choice([i for i in range(wide) if not 36 < i < 50], 4, replace=False):
            row[at:at + 5] = rng.integers(1, 1 << 24, len(row[at:at + 5]))
        row[method.reach] = 7
    code, keys = np.full(n, 3, np.uint64), np.arange(n)
    want, compared = every_pair(method, code, keys, near), []
    verified = method._verified
    method._verified = lambda x, y, *more: compared.append(len(x)) or verified(x, y, *more)
    assert searched(method, code, keys, near) == want and sum(w[0] < 127 for w in want) > n // 2
    assert sum(compared) < 4 * n


def test_large_buckets_are_merged_by_ranges_of_hashes(monkeypatch):
    """The verdicts do not depend on how many rows are merged at once, nor on the order of the runs."""
    rng, method = np.random.default_rng(11), cw._Windows(5, 12, 0.8, 3)
    wide = 2 * method.reach + 1
    base, parts = rng.integers(1, 1 << 24, (5, wide), dtype=np.uint32), []
    for run in range(4):
        code = np.sort(rng.choice(np.array([1, 2, 3, 1 << 63, (1 << 64) - 1][:run + 2], np.uint64), 30))  # not every run has every hash
        near = base[rng.integers(0, 5, 30)]
        near[:, :3] = rng.integers(1, 4, (30, 3))
        row = np.concatenate((code.astype(">u8").view(np.uint8).reshape(-1, 8),
                              near.view(np.uint8).reshape(30, -1, 4)[:, :, :3].reshape(30, -1)), 1)
        parts.append(runs.pack(rng.integers(0, 40, 30).astype("<i8"), row))
    whole = [runs.unpack(m, "i1", "i1", "<i8") for m in method.merge(parts)]
    monkeypatch.setattr(cw, "_ROWS", 7)
    for order in ([0, 1, 2, 3], [2, 0, 3, 1]):
        for i, m in zip(order, method.merge([parts[i] for i in order])):
            assert all((x == y).all() for x, y in zip(whole[i], runs.unpack(m, "i1", "i1", "<i8")))
    assert sum((w[2] < 40).sum() for w in whole) > 60
