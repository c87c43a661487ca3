"""Collocations against brute force; counting in small parts against counting at once."""

import collections
import random
import re

import numpy as np
import pytest

from tests.llm import cases
from turnloom.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def _pieces(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split("[.,;:!?\n-\r]", low)]


def _count(rows, longest=4):
    f = collections.Counter()
    for text, lang in rows:
        for words in _pieces(text):
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f["und" if lang is None else lang, tuple(words[i:i + size])] += 1
    return f


def _brute(rows, top, least, share=80, scale=2_000_000):
    f, totals, out = _count(rows), collections.Counter(), []
    for (lang, g), n in f.items():
        if len(g) == 1:
            totals[lang] += n
    held = collections.Counter()
    for (lang, g), n in f.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                part = (lang, g[i:i + size])
                held[part] = max(held[part], n if n >= least else 0)
    by_lang = collections.defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least or (held[lang, g] >= least and 100 * held[lang, g] >= share * a):
            continue
        cuts = []
        for k in range(1, len(g)):
            l, r = f[lang, g[:k]], f[lang, g[k:]]
            cuts.append((scale * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(g).encode(), l, r))
    for lang, found in by_lang.items():
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s)
                for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _rows(seed, n=150):
    rng = random.Random(seed)
    fixed = ["new york city hall", "once upon a time", "a b c d e", "des Champs ÉLYSÉES", "x\x1cy zz", "q q q q q q"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else f"{rng.choice('abcXY')}{int(rng.paretovariate(0.7)) % 40}"
                 for _ in range(rng.randrange(1, 60))]
        text = " ".join(w + rng.choice(["", "", "", ".", "\t", "\n", "?!", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None, "a\nb", ""])))
    return rows + [(None, "en"), ("", None), (" . \n", "fr"), ("only once", "xx"), ("same same same " * 50, "en")] + rows[:9]


def _mine(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, c.mine(spark, docs.repartition(3), **options).collect()))


@pytest.mark.parametrize("top,least,first,bits", [(2000, 3, None, c.BITS), (7, 3, 4, 64), (25, 2, 10, 1 << 16)])
def test_mine(spark, top, least, first, bits):
    rows = _rows(top)
    got = _mine(spark, rows, top=top, least=least, first=first, bits=bits)
    want = _brute(rows, top, least)
    assert len(want) > 20 and any(len(r[2].split(" ")) == 4 for r in want) and got == want


def test_ties_end_by_phrase(spark):
    rows = [(" . ".join(f"w{i} v{i}" for i in range(40)), "en")] * 5
    assert _mine(spark, rows, top=9, least=3, first=2) == _brute(rows, 9, 3)


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(_rows(5, 30))], SCHEMA)
    wide = docs.selectExpr("*", *[f"'q' AS {n}" for n in ("key", "f", "phrase", "size", "score", "a", "l", "r", "n", "cutoff")])
    assert sorted(map(tuple, c.mine(spark, wide, least=3).collect())) == _brute(_rows(5, 30), 2000, 3)
    assert c.mine(spark, docs.limit(0)).count() == 0
    assert c.mine(spark, docs, least=10**6).count() == 0
    assert c.mine(spark, cases.table(spark)).where("score < 0 OR a < 30").count() == 0


@pytest.mark.parametrize("part,flush", [(1, 4), (10, 9), (1 << 22, 50)])
def test_parts_of_long_texts(monkeypatch, part, flush):
    monkeypatch.setattr(c, "_PART", part)
    monkeypatch.setattr(c, "FLUSH", flush)
    rows = [(t, l or "und") for t, l in _rows(3, 40)]
    full = np.full(8, 255, np.uint8)
    want = collections.Counter({(l, " ".join(g)): n for (l, g), n in _count(rows).items()})
    for wanted in (c.Wanted((1,)), c.Wanted((2,), full), c.Wanted((3,), full, full, {3: full}, {3: full}),
                   c.Wanted((3, 4), full, full, {3: full, 4: full}, {4: full})):
        got, counter = collections.Counter(), c.Counter(wanted)

        def take(found):
            for keys, numbers in found:
                for key, n in zip(keys, numbers.tolist()):
                    lang, _, phrase = key.decode().rpartition("\n")
                    if phrase:
                        got[lang, phrase] += n

        for text, lang in rows:
            take(counter.read(lang.encode(), (text or "").encode()))
        take(counter.flush())
        assert got == {k: n for k, n in want.items() if len(k[1].split(" ")) in wanted.sizes}
