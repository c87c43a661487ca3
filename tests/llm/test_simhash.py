"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from turnloom.llm import simhash
from turnloom.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, near):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def _expected(texts):
    marks = {t: brute_fingerprint(t) for t in {t for _, t in texts}}
    roots = brute_roots(sorted(set(marks.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, t in texts:
        if i is not None:
            low[roots[marks[t]]] = min(i, low.get(roots[marks[t]], i))
    return sorted(((i, marks[t], low.get(roots[marks[t]])) for i, t in texts), key=repr)


def _got(out):
    return sorted(((r.doc_id, r.fingerprint % 2**64, r.component) for r in out.collect()), key=repr)


def test_groups(spark):
    docs = cases.table(spark)
    want = _expected(cases.texts())
    assert _got(simhash.groups(spark, docs)) == want
    assert _got(simhash.groups(spark, cases.clashing(spark, docs))) == want
    assert simhash.groups(spark, docs.limit(0)).count() == 0
    kept = [r.doc_id for r in simhash.one_of_each(spark, docs).collect()]
    assert sorted(k for k in kept if k) == sorted({i for i, _, c in want if i and i == c})  # equal rows fall to one


def test_one_row_of_each_component_stays(spark):
    rows = cases.repeated_keys()
    docs = cases.table(spark, rows)
    for table in (docs, docs.selectExpr("*", "1 AS key", "2 AS digest", "3 AS given", "4 AS _copy_key", "5 AS n")):
        out = simhash.one_of_each(spark, table)
        assert out.columns == table.columns
        texts = dict((t, i) for i, t in reversed([r for r in rows if r[0] is not None and r[1]]))
        want = [(None, rows[0][1]), (11, None), *[(i, t) for t, i in texts.items()]]
        got = [(r.doc_id, r.text or None) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [2048, 3])
def test_links_connect_all_near_fingerprints(spark, block):
    rng = random.Random(11)
    marks = [0, 2**64 - 1, 2**63]
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            marks.append(at)
            for _ in range(rng.randrange(5)):
                at ^= 1 << rng.randrange(64)
    marks = sorted(set(marks))
    rows = [(int(np.array(m, "<u8").view("<i8")),) for m in marks]
    frame = spark.createDataFrame(rows, "fingerprint long")
    found = components(spark, simhash.links(spark, frame, block=block)).collect()
    groups = {r.node % 2**64: r.root % 2**64 for r in found}
    want = brute_roots(marks, lambda a, b: (a ^ b).bit_count() <= 3)
    for a in marks:
        for b in marks:
            assert (want[a] == want[b]) == (groups.get(a, a) == groups.get(b, b))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 501), (501, 500)]
    frame = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(spark, frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 500: 500, 501: 500}
    assert components(spark, frame.limit(0)).count() == 0
