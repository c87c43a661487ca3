"""Token counts by finite-state transducers against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from turnloom.llm import token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    parts = ["a", "B", "'s", "'", "1", "²", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", ".", "!?",
             "中", "é", "é", "\U0001f642", "zz9", "9z", "'re", "'ve", "'ll", "'r", "'l", "v", "l", "e", "the",
             "ing", "<|endoftext|>", "<|end", "aaaa", "----", "ÃÂ", " th", " an", "'S", "'LL"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    spans = [(32, 127), (0x80, 0x800), (0x800, 0xD800), (0x10000, 0x110000)]
    texts += ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(40)) for _ in range(1000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)) for _ in range(20)]
    return texts + ["", "x" * 3000, "ab" * 5000, "中文字" * 4000, " " * 1000 + "a", "the" * 300]


def test_counts_equal_the_library(made, library):
    assert token_counts.TokenCounter(FILE).counts(made).tolist() == library(made)


@pytest.mark.parametrize("block", [1, 2, 7, 50])
def test_small_blocks_and_tables_change_nothing(made, library, block):
    few = made[:150] + made[-3:-1]
    machine = token_counts.TokenCounter(FILE, block=block, states=50)
    assert machine.counts(few).tolist() == library(few)


def test_scan_equals_one_step_after_the_other():
    splitter, rng = token_counts.Splitter(), np.random.default_rng(1)
    symbols = rng.integers(0, 144, 1000).astype(np.uint8)
    for state in range(9):
        marks, last = splitter.run(symbols, state)
        at, want = state, []
        for s in symbols.tolist():
            at, mark = token_counts._step(at, s // 12, s % 12)
            want.append(mark)
        assert marks.tolist() == want and last == at


def test_a_million_words(library):
    rng = random.Random(8)
    text = " ".join(rng.choice(["the", "Éieruer", "of", "x9", "thtionnd", "中文", "\n"]) for _ in range(1_000_000))
    assert token_counts.TokenCounter(FILE).counts([text]).tolist() == library([text])


def test_documents(spark, library):
    docs = cases.table(spark)
    out = token_counts.count_tokens(docs, FILE)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = library([t or "" for _, t in cases.texts()])
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(cases.texts(), counts)]
    assert cases.rows(out) == sorted(want, key=repr)
    assert cases.rows(token_counts.count_tokens(cases.clashing(spark, docs), FILE)) == cases.rows(out)
    assert token_counts.count_tokens(docs.limit(0), FILE).count() == 0


def test_query(spark, sf_dir, library):
    from turnloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = library([r.text or "" for r in docs])
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(docs, counts)]
    assert cases.rows(QUERIES["op11_finite_state_counts"](spark, sf_dir)) == sorted(want, key=repr)
