"""Byte-level encoding and packing against the tokenizer libraries."""

import base64
import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import cases
from turnloom.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(spark, encoder):
    docs = cases.table(spark)
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, limit=50), RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "ids", "decoded"]
    want = [(i, np.array(encoder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
            for i, t in cases.texts()]
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    wide = cases.clashing(spark, docs)
    assert cases.rows(bpe.encode(wide, RANKS, public_tokenizers.PATTERN)) == cases.rows(
        bpe.encode(docs, RANKS, public_tokenizers.PATTERN))
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_cutting_long_texts_changes_nothing(encoder):
    rng = random.Random(3)
    alphabet = ["a", "B", "'s", "'", "1", "²", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", ".", "!?",
                "中", "é", "é", "\U0001f642", "zz9", "9z"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
        want = np.array(encoder.encode_ordinary(text), "<u4").tobytes()
        for limit in (1, 7, 30):
            assert "".join(bpe.pieces(text, limit)) == text
            assert bpe.token_ids(encoder, text, limit) == want


def test_word_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(WORDS)
    ids_of = packing.WordIds(WORDS, cached=20)
    rng = random.Random(5)
    alphabet = list("aeTHst'.,!? \n39<|>") + ["'re", "ß", "É", "×", "µ", "İ", "Σ", " ", "\x1c",
                                              "é", "中", "\U0001f642", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    assert ids_of(b"a<|endoftext|>b") == np.array(tokenizer.encode("a").ids + [49407] + tokenizer.encode("b").ids, "<u4").tobytes()
    for text in [t or "" for _, t in cases.texts()] + made:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids_of(text.encode()) == want


def _check(rows, docs, capacity):
    """Every document whole and in order, every sequence gapless and within the capacity."""
    ids_of = packing.WordIds(WORDS, plain=False)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, text in docs:
        ids = ids_of((text or "").encode()) + bytes(4)
        for n, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at:at + 4 * capacity]
            want.append((i, n, at // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted(want, key=repr) == sorted((tuple(r)[:5] for r in rows), key=repr)
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_pack(spark, capacity):
    docs = cases.table(spark)
    out = packing.pack(spark, docs, WORDS, capacity)
    made = _check(out.collect(), cases.texts(), capacity)
    total = out.agg({"length": "sum"}).first()[0]
    assert made <= 1.2 * total / capacity + 2
    assert packing.pack(spark, docs.limit(0), WORDS).count() == 0
    wide = packing.pack(spark, cases.clashing(spark, docs.repartition(3)), WORDS, capacity)
    assert _check(wide.collect(), cases.texts(), capacity) == made


@pytest.mark.parametrize("capacity", [1, 2, 3, 9, 10, 50])
def test_plan_places_every_rank_once(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {n: rng.randrange(1, 30) for n in range(1, capacity + 1) if rng.random() < 0.5}
        steps, bins = packing.plan(counts, capacity), collections.defaultdict(list)
        for length, n in counts.items():
            own = [s for s in steps.tolist() if s[0] == length]
            for rank in range(n):
                _, first, sequence, per, offset = [s for s in own if s[1] <= rank][-1]
                bins[sequence + (rank - first) // per].append((offset + (rank - first) % per * length, length))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
            assert sum(n for _, n in parts) <= capacity
        large = sum(n for length, n in counts.items() if 2 * length > capacity)
        assert len(bins) <= max(large, 1.5 * sum(a * b for a, b in counts.items()) / capacity + 1) + 1
