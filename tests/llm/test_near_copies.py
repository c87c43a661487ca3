"""Groups of near copies against brute force over all pairs of distinct texts."""

import os
import random

import pytest

from tests.conftest import DATA
from tests.llm import cases
from turnloom.llm import near_copies


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(texts):
    """Pairs of different sets of five-word shingles with a similarity of 0.8 or more."""
    sets = sorted({shingled(t) for t in texts}, key=lambda s: (len(s), sorted(s)))
    places, out = {}, []
    for i, own in enumerate(sets):
        shared = {}
        for g in own:
            for j in places.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            places[g].append(i)
        out += [(sets[j], own) for j, n in shared.items() if 10 * n >= 8 * (len(own) + len(sets[j]) - n)]
    return out


def brute(rows):
    """Least key of the group of each row (key, text)."""
    root = {s: s for s in (shingled(t) for _, t in rows)}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s
    for a, b in similar_pairs([t for _, t in rows]):
        root[top(a)] = top(b)
    low = {}
    for key, text in rows:
        at = top(shingled(text))
        low[at] = min(key, low.get(at, key))
    return sorted((key, low[top(shingled(text))]) for key, text in rows)


def got(out):
    rows = [(r.key, r.root) for r in out.collect()]
    low = {}
    for key, root in rows:
        low[root] = min(key, low.get(root, key))
    return sorted((key, low[root]) for key, root in rows)


def framed(spark, rows):
    return spark.createDataFrame([(i, t, str(hash(t))) for i, t in rows], "key long, text string, digest string")


def variants():
    """Texts with copies of all degrees, chains of edits, a crowd of variants, cells of unlike members."""
    rng, texts = random.Random(5), []
    for n in (6, 9, 30, 60, 120, 400):
        for _ in range(6):
            words = cases.words(n, rng.randrange(10**9)).split()
            texts.append(" ".join(words))
            for _ in range(5):  # a chain: each a few words from the one before
                for _ in range(rng.randrange(1, max(2, n // 40))):
                    words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(words))
    crowd = cases.words(90, 77).split()
    for _ in range(150):  # different variants of one text
        words = list(crowd)
        words[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    half = cases.words(50, 78)
    texts += [half + " " + cases.words(50, 900 + i) for i in range(60)]  # alike by a third: no links
    texts += [texts[3].upper(), texts[3].replace(" ", "\n"), texts[3], "", " \n", None, "one", "One", "one two"]
    texts += ["verse " + "and again we say it all " * 40, "verse " + "and again we say it all " * 90]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1024, 7])
def test_groups_of_variants(spark, block):
    rows = variants()
    assert got(near_copies.grouped(spark, framed(spark, rows), block=block)) == brute(rows)


def test_crowded_by_volume(spark):
    rows = variants()[-220:]
    assert got(near_copies.grouped(spark, framed(spark, rows), volume=500)) == brute(rows)


def test_all_similar_documents_are_found(spark):
    """sf0.01 has pairs of different texts that radius 3 of a fingerprint does not find."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(os.path.join(DATA, "sf0.01", "documents.parquet")).collect()]
    assert len(similar_pairs([t for _, t in rows])) >= 5
    assert got(near_copies.grouped(spark, framed(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    docs = cases.table(spark)
    rows = [(i, t) for i, t in cases.texts() if i is not None]
    want = sorted({low for _, low in brute(rows)})
    for table in (docs, cases.clashing(spark, docs)):
        out = near_copies.one_of_each(spark, table)
        assert out.columns == table.columns
        kept = [r.doc_id for r in out.collect()]
        assert sorted(k for k in kept if k is not None) == want and kept.count(None) == 2
    assert near_copies.one_of_each(spark, docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = cases.repeated_keys()
    docs = cases.table(spark, rows)
    for table in (docs, docs.selectExpr("*", "1 AS key", "2 AS digest", "3 AS given", "4 AS n")):
        got_rows = [(r.doc_id, r.text or None) for r in near_copies.one_of_each(spark, table).collect()]
        texts = dict((t, i) for i, t in reversed([r for r in rows if r[0] is not None and r[1]]))
        want = [(None, rows[0][1]), (11, None), *[(i, t) for t, i in texts.items()]]
        assert sorted(got_rows, key=repr) == sorted(want, key=repr)
