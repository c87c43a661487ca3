"""Toxic passages as maximum-scoring segments of token log-odds, and a calibrated document score.

Tokens are lower-cased words. Each word is the leaf of a small tree: its first 3 to 9 characters,
then the word. Per node, the labelled sample gives the numbers of toxic and clean texts that hold it;
a Dirichlet prior centred on the parent's share smooths them, so rare words inherit what their stem
says. A node whose log-odds against the base rate is significant (z) and at least EFFECT scores its
words; all other words cost `drift`. One linear scan (Ruzzo and Tompa) then yields every maximal scoring segment.

Segments are calibrated as extreme values (Karlin and Altschul): with the background of the clean
texts, a text of n words is expected to hold K n exp(-lambda S) segments of score S or more. The sum
over its segments of lambda S - ln(K n), where positive, is the document's evidence; a logistic fit on
the sample makes it a probability.

Fitting reads at most `bounds` distinct labelled texts (a parameter); only counts that two or more
toxic texts share reach the driver, at most a few per sampled text. Scoring maps rows where they lie,
over whole texts. Defined results: a null or empty text has no words and no evidence; other columns
are not read; an empty table gives an empty table; a sample without a class gives a constant score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import keyed, small
from turnloom.llm.labelled import logistic, sample
from turnloom.session import write_table

WORD = re.compile(r"\w+")
STEMS = (9, 8, 7, 6, 5, 4, 3)
BOUNDS = {1: 4000, 0: 16000}
DRIFT = 0.3
PRIOR = 4.0
SIGNIFICANT = 4.0
EFFECT = 1.5  # least log-odds of a node that scores: common words lean a little either way
SUPPORT = 4
_REMEMBERED = 300_000


def nodes(word: str) -> list[str]:
    """The word's path in the tree, leaf first; stems end in `*`."""
    return [word, *[word[:n] + "*" for n in STEMS if n < len(word)]]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0
    drift: float = DRIFT


class _Lookup(dict):
    """Score of a word: that of its deepest significant node, else zero."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def __missing__(self, word: str) -> float:
        if len(self) > _REMEMBERED:
            self.clear()
        score = next((self.scores[n] for n in nodes(word) if n in self.scores), 0.0)
        self[word] = score
        return score


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), given the positions that score above
    zero; every other position costs `drift`. Linear: each candidate remembers the nearest one to its
    left that starts lower, and the search jumps along those."""
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, jump
    total, at = 0.0, 0
    for i, score in hits:
        total -= drift * (i - at)
        first, last, low, high = i, i, total, total + score
        total, at = high, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((first, last, low, high, j))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(first, last, high - low) for first, last, low, high, _ in found]


def _evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    base = math.log(max(model.k * n, 1e-12))
    return sum(max(0.0, model.lam * s - base) for _, _, s in found)


def _count(rows: DataFrame) -> DataFrame:
    """(node, toxic, clean, words): texts that hold each node; the node '' holds all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = (Counter(), Counter()), [0, 0]
        for batch in small(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = WORD.findall(text.lower())
                counts[label].update({n for w in set(words) for n in nodes(w)})
                counts[label][""] += 1
                total[label] += len(words)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from emit(counts)
                counts = (Counter(), Counter())
        counts[0]["\0"], counts[1]["\0"] = total
        yield from emit(counts)

    def emit(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()),
                               pa.array([counts[0][n] for n in names], pa.int64())],
                              names=["node", "toxic", "clean"])

    parts = rows.select("text", "label").mapInArrow(run, "node string, toxic long, clean long")
    return parts.groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weights(counted: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, tuple[float, int]]:
    """Significant nodes that speak for toxicity: log-odds against the base rate, and clean texts."""
    base = (toxic + 0.5) / (toxic + clean + 1)
    share, kept = {}, {}  # share: of toxic and of clean texts, each on its own since one may be tiny
    for node in sorted(counted, key=lambda n: (not n.endswith("*"), len(n), n)):  # parents first
        word = node.rstrip("*")
        parent = next((word[:n] + "*" for n in STEMS if n < len(word) and word[:n] + "*" != node), None)
        above, below = share.get(parent, (base, 1 - base))
        t, c = counted[node]
        a, b = t + PRIOR * above, c + PRIOR * below
        share[node] = a / (a + b), b / (a + b)
        odds = math.log(a / b) - math.log(base / (1 - base))
        # its own texts alone, against the base rate
        a, b = t + PRIOR * base, c + PRIOR * (1 - base)
        alone = math.log(a / b) - math.log(base / (1 - base))
        if odds >= EFFECT and alone / math.sqrt(1 / a + 1 / b) >= SIGNIFICANT:
            kept[node] = (alone, c)
        elif odds < EFFECT and kept.get(parent, (0.0,))[0] > 0:
            kept[node] = (0.0, c)  # its stem misjudges it
    return kept


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic",
        bounds: dict[int, int] | None = None) -> Model:
    """A model from the labelled texts that `usable` (over `labels`) admits."""
    rows = write_table(spark, "toxic_sample", sample(docs, labels, label, usable, bounds or BOUNDS))
    counted = {r.node: (r.toxic, r.clean) for r in _count(rows).where(
        (F.col("toxic") >= SUPPORT) | F.col("node").isin("", "\0")).collect()}
    toxic, clean = counted.pop("", (0, 0))
    _, clean_words = counted.pop("\0", (0, 0))
    weights = _weights(counted, toxic, clean)
    model = Model({n: s for n, (s, _) in weights.items()})
    # background: every significant node as often as the clean texts hold it, half a time at least
    back = [(s, (c + 0.5) / (clean_words + 1)) for s, c in weights.values() if s > 0]
    if back:
        scores, chance = np.array(back).T
        rest = max(0.0, 1 - chance.sum())
        low, high = 1e-3, 50.0
        for _ in range(80):  # the positive root of E[exp(lambda s)] = 1
            mid = (low + high) / 2
            above = math.log(float(np.exp(np.minimum(mid * scores, 600)) @ chance) + rest * math.exp(-mid * DRIFT)) > 0
            low, high = (low, mid) if above else (mid, high)
        model.lam = (low + high) / 2
    found = _evaluate(rows, model, "label").toPandas()  # one small row per sampled text
    none = found[found.label == 0]
    least = min((s for s, _ in back), default=1.0)
    expected = float((none.n_words * math.exp(-min(model.lam * least, 600))).sum())
    model.k = float(np.clip((none.n_segments.sum() + 0.5) / max(expected, 1e-9), 1e-6, 1e6))
    found = _evaluate(rows, model, "label").toPandas()
    model.slope, model.intercept = logistic(
        np.log1p(found.evidence.to_numpy()), found.label.to_numpy().astype(float))
    return model


def _evaluate(rows: DataFrame, model: Model, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(model.scores)
        for batch in small(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text.lower())
                found = segments([(i, s) for i, s in enumerate(map(lookup.__getitem__, words)) if s], model.drift)
                out.append((len(words), len(found), max((s for *_, s in found), default=0.0),
                            _evidence(model, len(words), found)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.float64(), pa.float64()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns, *[batch.column(c) for c in more]],
                names=["key", "n_words", "n_segments", "best", "evidence", *more])

    schema = "key long, n_words long, n_segments long, best double, evidence double" + "".join(
        f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    return rows.select("key", "text", *more).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_words, n_segments, best, evidence) of every whole text."""
    line = F.log1p("evidence") * model.slope + model.intercept
    return _evaluate(keyed(docs, key, text), model).select(
        F.col("key").alias(key), (1 / (1 + F.exp(-line))).alias("score"),
        "n_words", "n_segments", "best", "evidence")


def passages(docs: DataFrame, model: Model, expect: float = 0.05, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(key, start, end, score, expected): every passage, in characters, of which fewer than `expect`
    such are expected by chance in a text of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(model.scores)
        for batch in small(batches):
            out = []
            for name, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                spans, hits = [], []
                for i, m in enumerate(WORD.finditer(body)):
                    spans.append(m.span())
                    if s := lookup[m.group().lower()]:
                        hits.append((i, s))
                for a, b, s in segments(hits, model.drift):
                    by_chance = model.k * len(spans) * math.exp(-model.lam * s)
                    if by_chance < expect:
                        out.append((name, spans[a][0], spans[b][1], s, by_chance))
            columns = zip(*out) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             names=["key", "start", "end", "score", "expected"])

    return keyed(docs, key, text).mapInArrow(
        run, "key long, start int, end int, score double, expected double").withColumnRenamed("key", key)
