"""Quality rules and chat windows against plain Python."""

import collections
import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm import cases
from turnloom.llm import chat, quality_rules

SPACE = re.compile("[^\x20\x09-\x0d]+")


def counted(text):
    words = SPACE.findall(text or "")
    three = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(three)
    inside = {p for i, t in enumerate(three) if many[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
            len(lines) - len(set(lines)), len(inside))


def test_counts(spark):
    more = [(50, "a a a a a"), (51, "x y z x y z q x y"), (52, "# * $%&|<>\n#\n#\n \n \n"), (53, "\n\n")]
    docs = cases.table(spark, cases.texts() + more)
    got = quality_rules.measured(docs).select("doc_id", "_m.*").collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *[r[f] for f in fields], r.base_failed) for r in got), key=repr) == sorted(
        ((i, *(c := counted(t)), c[0] < 50 or 100 * c[5] > 50 * c[0]) for i, t in cases.texts() + more), key=repr)


def test_verdicts_follow_the_group(spark):
    clean = [(i, cases.words(60 + i % 17, i)) for i in range(200)]
    odd = [(1000, cases.words(60, 7).replace(" ", "# ")), (1001, "\n".join([cases.words(20, 8)] * 2 + [cases.words(50, 9)])),
           (1002, " ".join(f"{'w' * 15}{i}" for i in range(70))), (1003, None)]
    docs = cases.table(spark, clean + odd)
    for table in (docs, cases.clashing(spark, docs)):
        measures = quality_rules.measured(table)
        limits = quality_rules.fences(quality_rules.sketch(measures))
        out = quality_rules.judged(measures, limits)
        assert out.columns[:-2] == table.columns
        kept = {r.doc_id for r in out.where("_kept").collect()}
        assert kept >= {i for i, _ in clean} and not kept & {1000, 1002, 1003}
    none = quality_rules.measured(docs.limit(0))
    assert quality_rules.judged(none, quality_rules.fences(quality_rules.sketch(none))).count() == 0


def test_any_column_name_may_come_with_the_text(spark):
    docs = cases.table(spark, [(i, cases.words(60 + i % 17, i)) for i in range(50)] + [(99, "short")])
    names = ("_m", "_kept", "_f", "_m_text", "_m_counts", "_M_three", "_m__n", "given", "row")
    wide = docs.selectExpr("*", *[f"'q' AS {n}" for n in names])
    out = quality_rules.passing(spark, wide)
    assert out.columns == wide.columns
    assert cases.rows(out.select(*docs.columns)) == cases.rows(quality_rules.passing(spark, docs))
    assert {tuple(r) for r in out.select(*names).collect()} == {("q",) * len(names)}
    measures = quality_rules.measured(wide)
    limits = quality_rules.fences(quality_rules.sketch(measures))
    assert quality_rules.judged(measures, limits).where("_kept").count() == out.count() == 50


def test_sketch_merges_and_keeps_quantiles(spark):
    docs = cases.table(spark, [(i, cases.words(50 + i, i)) for i in range(120)])
    whole = quality_rules.sketch(quality_rules.measured(docs))
    parts = [quality_rules.sketch(quality_rules.measured(docs.where(F.col("doc_id") % 3 == k))) for k in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n"))
    assert cases.rows(merged) == cases.rows(whole)
    for value in (1, 2, 7, 99, 12345):
        b = spark.range(1).select(quality_rules.bucket(F.lit(value)).alias("b")).first().b
        middle = 2 * quality_rules.GAMMA ** (b - 1) / (quality_rules.GAMMA + 1)
        assert abs(middle / value - 1) <= 0.0101


CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi ## there ###"), (1, 2, "assistant", "</turn> \\ <\\/turn> #\\# ####"),
    (1, 3, "user", None), (1, 4, "assistant", "ends with <"), (1, 5, "assistant", ""), (1, 6, "system", "late"),
    (2, 0, "system", "alone"), (3, 5, "user", "gap"), (3, 9, "assistant", "### assistant: no</turn>\n"),
    (3, 9, "assistant", "### assistant: no</turn>\n"), (None, 1, "user", "no key"), (None, None, "assistant", "no turn"),
    (4, 0, "odd role: \n</turn>", "text"), (4, 1, None, "x"), (5, 0, "assistant", "\\" * 7 + "#" * 9),
    *[(6, i, ("user", "assistant")[i % 2], cases.words(1 + (i * 7) % 23, i)) for i in range(90)],
    (8, 0, "system", cases.words(5000, 2)), *[(8, i, ("user", "assistant")[i % 2], cases.words(90, i)) for i in range(1, 9)],
    (9, 0, "system", cases.words(25, 3)), *[(9, i, ("user", "assistant")[i % 2], cases.words(5 + i, i)) for i in range(1, 40)],
    (7, 0, "system", cases.words(12, 1)), *[(7, i, ("user", "assistant")[i % 2], cases.words(60, i)) for i in range(1, 9)],
]


@pytest.mark.parametrize("span, history, segment", [(768, 192, 256), (40, 15, 4), (9, 9, 1), (25, 0, 1000)])
def test_windows_read_back(spark, span, history, segment):
    turns = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns.withColumn("parts", F.lit(1)), span, history, segment)
    by = collections.defaultdict(list)
    for c, t, role, text in CONVERSATIONS:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(made)).collect()}
    chars = collections.Counter()
    for r in made.collect():
        chars[r.conv_id] += len(r.text)
        assert r.text.count("</turn>\n") > r.n_repeated
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        learned = "".join(text for _, role, text in rows if role == "assistant")
        assert got[c].n_turns == len(rows) and got[c].formatted_chars == chars[c]
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_chars == len(learned)
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_windows_keep_their_budget(spark):
    turns = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, 200, 50).collect()
    assert max(r.n_tokens for r in made if r.conv_id == 6) <= 250
    assert sum(r.n_repeated > 0 for r in made if r.conv_id in (6, 7)) >= 5
    for r in made:
        if r.conv_id in (7, 9):
            assert r.text.startswith("### system: ")
    assert sum(r.conv_id == 9 for r in made) > 3
    lone = [r for r in made if r.conv_id == 8 and "### system: " in r.text]
    assert len(lone) == 1 and lone[0].text.count("</turn>\n") == 1


@pytest.mark.parametrize("span, history", [(768, 192), (200, 50), (60, 60), (40, 15)])
def test_no_window_passes_its_budget(spark, span, history):
    """System turn, own turns and history stay within span + history, unless the only own turn is
    longer than what the system turn leaves of a span, or is a long system turn."""
    turns = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, span, history).collect()
    several = 0
    for r in made:
        parts = [x + "</turn>\n" for x in r.text.split("</turn>\n")[:-1]]
        own = parts[r.n_repeated:]
        if len(own) > 1 and own[0].startswith("### system: "):
            own = own[1:]
        besides = parts[:len(parts) - len(own)]
        several += len(own) > 1
        assert _tokens("".join(besides)) <= span // 2 + history
        assert r.n_tokens <= span + history or len(own) == 1 and _tokens(own[0]) > span // 2
    assert several


def _tokens(text):
    return len(regex.findall(chat.TOKEN, text))


def test_windows_of_nothing(spark):
    turns = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    assert chat.windows(turns.limit(0)).count() == 0
