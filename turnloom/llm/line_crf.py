"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are measures of the line and of the lines before and after
it; the chain adds how often good and bad lines follow each other. Labels exist for documents only,
so fitting alternates: the field is fitted on assumed line labels (all lines of a bad document bad),
then the lines of bad documents that it finds good are taken as good, the worst one apart. Forward
and backward sums give the chance that each line is good; their mean weighted by line length is the
document's quality, which a logistic fit makes a probability.

Fitting reads at most `bounds` distinct labelled texts (a parameter); the driver holds their line
measures, not their texts. Scoring maps rows where they lie, over whole texts. Defined results: a
null or empty text is one empty line; other columns are not read; an empty table gives an empty
table; a sample without a class gives a constant score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import keyed, small
from turnloom.llm.labelled import logistic, sample
from turnloom.session import write_table

BOUNDS = {0: 2500, 1: 3500}
LINES = 500_000  # of all sampled texts together; a text of more than a tenth of it is not sampled
ROUNDS, STEPS = 3, 120
_DIGITS, _SYMBOLS, _MARKS = b"0123456789", b"#*$%&|<>@^~\\{}[]=_+/", b"!?.,;:"
MEASURES = 13
_LONG = 4096  # lines from which a block of documents is cut into pieces
_CELLS = 1 << 19  # lines and padding of a block that are never too many


def measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x MEASURES) and the length of each line, one character added."""
    out, lengths, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        raw, n = line.encode("utf-8", "replace"), len(words)
        size, many = max(len(raw), 1), max(n, 1)
        strange = len(raw) - len(raw.translate(None, _SYMBOLS))
        marks = len(raw) - len(raw.translate(None, _MARKS))
        digits = len(raw) - len(raw.translate(None, _DIGITS))
        again = line in seen and n > 0
        seen.add(line)
        out.append((
            1.0, math.log1p(n), min(len(line) / many / 10, 3.0),
            sum(map(str.isupper, words)) / many, 10 * strange / size, 10 * marks / size, digits / size,
            1 - len(set(words)) / many if n else 0.0,
            sum(a == b for a, b in zip(words, words[1:])) / many,
            1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 0.0,
            float(again), float(n == 0), float(raw[-1:] in (b".", b"!", b"?")),
        ))
        lengths.append(len(line) + 1)
    return np.array(out), np.array(lengths, float)


def _with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own measures, then those of the line before and after inside the same document (`first` marks
    where documents begin)."""
    last = np.append(first[1:], True)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after])


@dataclass
class Model:
    weights: np.ndarray  # of a line's features, for bad against good
    moves: np.ndarray  # moves[a, b]: from a to b, good is 0
    slope: float = 0.0
    intercept: float = 0.0

    def good(self, own: np.ndarray) -> np.ndarray:
        """The chance that each line of one document is good, by forward and backward sums of odds."""
        first = np.zeros(len(own), bool)
        first[0] = True
        unary = (_with_neighbours(own, first) @ self.weights).tolist()
        (gg, gb), (bg, bb) = np.exp(self.moves).tolist()
        n, exp, log = len(unary), math.exp, math.log
        forward, backward, carry = [0.0] * n, [0.0] * n, 0.0
        for i, u in enumerate(unary):  # log-odds of bad, given the lines so far
            forward[i] = carry = min(max(u + carry, -50.0), 50.0)
            e = exp(carry)
            carry = log((gb + bb * e) / (gg + bg * e))
        carry = 0.0
        for i in range(n - 1, -1, -1):
            backward[i] = carry
            e = exp(min(max(unary[i] + carry, -50.0), 50.0))
            carry = log((bg + bb * e) / (gg + gb * e))
        return 1 / (1 + np.exp(np.clip(np.array(forward) + np.array(backward), -50, 50)))

    def quality(self, text: str) -> float:
        """Length-weighted mean chance of good, as log-odds."""
        own, lengths = measures(text)
        mean = float(self.good(own) @ lengths / lengths.sum())
        return math.log((mean + 1e-3) / (1 - mean + 1e-3))


def _chain(unary: np.ndarray, moves: np.ndarray, where: np.ndarray, held: np.ndarray):
    """Marginals, expected moves and log-partition of many documents at once (padded, log space)."""
    docs, steps = where.shape
    if steps > _LONG:
        return _long_chain(unary, moves, where, held)
    u = np.where(held, unary[where], 0.0)
    score = np.stack([np.zeros_like(u), u], 2)
    forward, backward = np.zeros((docs, steps, 2)), np.zeros((docs, steps, 2))
    forward[:, 0] = score[:, 0]
    for t in range(1, steps):
        new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + score[:, t]
        forward[:, t] = np.where(held[:, t, None], new, forward[:, t - 1])
    for t in range(steps - 2, -1, -1):
        new = np.logaddexp.reduce(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(held[:, t + 1, None], new, 0.0)
    whole = np.logaddexp.reduce(forward[:, -1], axis=1)
    bad = np.exp(forward[..., 1] + backward[..., 1] - whole[:, None])
    pair = np.zeros((2, 2))
    for t in range(1, steps):
        on = held[:, t]
        if on.any():
            joint = (forward[on, t - 1, :, None] + moves + (score[on, t] + backward[on, t])[:, None, :]
                     - whole[on, None, None])
            pair += np.exp(joint).sum(0)
    return bad[held], pair, whole.sum()


def _long_chain(unary: np.ndarray, moves: np.ndarray, where: np.ndarray, held: np.ndarray):
    """`_chain` in about the square root of the steps: documents are cut into pieces, whose moves from
    the state before (after) them to each of their lines are found for all pieces at once."""
    docs, steps = where.shape
    size = math.isqrt(steps - 1) + 1
    pieces = -(-steps // size)
    fill = ((0, 0), (0, pieces * size - steps))
    on = np.pad(held, fill).reshape(docs, pieces, size)
    u = np.pad(np.where(held, unary[where], 0.0), fill).reshape(docs, pieces, size)
    score = np.stack([np.zeros_like(u), u], 3)
    stay = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    step = np.where(on[..., None, None], moves + score[..., None, :], stay)  # from the line before
    step[:, 0, 0] = score[:, 0, 0, None, :]

    def then(x, y):
        return np.logaddexp(x[..., :, :1] + y[..., :1, :], x[..., :, 1:] + y[..., 1:, :])

    down, up = step.copy(), np.empty_like(step)
    up[:, :, -1] = stay
    for t in range(1, size):
        down[:, :, t] = then(down[:, :, t - 1], step[:, :, t])
    for t in range(size - 2, -1, -1):
        up[:, :, t] = then(step[:, :, t + 1], up[:, :, t + 1])
    before, after = np.zeros((docs, pieces, 1, 2)), np.zeros((docs, pieces, 2, 1))
    before[:, 0, 0, 1] = -np.inf
    for p in range(1, pieces):
        before[:, p] = then(before[:, p - 1], down[:, p - 1, -1])
    for p in range(pieces - 2, -1, -1):
        after[:, p] = then(then(step[:, p + 1, 0], up[:, p + 1, 0]), after[:, p + 1])
    forward = then(before[:, :, None], down).reshape(docs, -1, 2)[:, :steps]
    backward = then(up, after[:, :, None]).reshape(docs, -1, 2)[:, :steps]
    whole = np.logaddexp.reduce(forward[:, -1], axis=1)
    bad = np.exp(forward[..., 1] + backward[..., 1] - whole[:, None])
    doc, t = np.nonzero(held[:, 1:])
    ahead = score.reshape(docs, -1, 2)[doc, t + 1] + backward[doc, t + 1]
    pair = np.exp(forward[doc, t][:, :, None] + moves + ahead[:, None, :] - whole[doc, None, None]).sum(0)
    return bad[held], pair, whole.sum()


def _alike(part: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Documents in order of length as blocks whose padding is at most their lines, or small."""
    if len(part) == 1 or count[part].max() * len(part) <= max(_CELLS, 2 * count[part].sum()):
        return [part]
    half = len(part) // 2
    return _alike(part[:half], count) + _alike(part[half:], count)


def _fit_chain(own: list[np.ndarray], labels: np.ndarray, ridge: float = 1.0) -> Model:
    """Fitted in blocks of documents of like length, so that padding stays small."""
    order = np.argsort([len(x) for x in own], kind="stable")
    own, labels = [own[i] for i in order], labels[order]
    count = np.array([len(x) for x in own])
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    first = np.zeros(count.sum(), bool)
    first[starts] = True
    x = _with_neighbours(np.vstack(own), first)
    target = np.repeat(1.0 - labels, count)  # 1 is bad
    blocks = []
    parts = np.array_split(np.arange(len(own)), max(1, len(own) // 200))
    for part in (p for many in parts for p in _alike(many, count)):
        steps = np.arange(count[part].max())
        held = steps < count[part][:, None]
        blocks.append((np.where(held, starts[part][:, None] + steps, 0), held))
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    bad_docs = np.flatnonzero(labels == 0)
    for round_ in range(ROUNDS):
        mean = [np.zeros_like(w), np.zeros((2, 2))]
        square = [np.zeros_like(w), np.zeros((2, 2))]
        inner = ~first
        seen = np.zeros((2, 2))
        np.add.at(seen, (target[:-1][inner[1:]].astype(int), target[1:][inner[1:]].astype(int)), 1)
        for step in range(1, STEPS + 1):
            unary = x @ w
            expected, pairs = np.zeros(len(x)), np.zeros((2, 2))
            for where, held in blocks:
                bad, pair, _ = _chain(unary, moves, where, held)
                expected[where[held]] = bad
                pairs += pair
            slopes = (x.T @ (expected - target) / len(x) + ridge * w / len(x),
                      (pairs - seen) / len(x) + ridge * moves / len(x))
            for i, (value, g) in enumerate(((w, slopes[0]), (moves, slopes[1]))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                value -= 0.1 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
        if round_ < ROUNDS - 1:
            unary = x @ w
            for where, held in blocks:
                expected[where[held]] = _chain(unary, moves, where, held)[0]
            for d in bad_docs:
                lines = slice(starts[d], starts[d] + count[d])
                target[lines] = expected[lines] >= 0.5
                target[starts[d] + int(np.argmax(expected[lines]))] = 1.0
    return Model(w, moves)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
        bounds: dict[int, int] | None = None, most: int = LINES) -> Model:
    """A model from the labelled texts that `usable` (over `labels`) admits: at most `bounds[y]` of each
    class and `most` lines in all, whole texts taken in the order of a hash of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = [measures(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"),
                 pa.array([m.astype("<f4").tobytes() for m, _ in made], pa.binary()),
                 pa.array([n.astype("<f4").tobytes() for _, n in made], pa.binary())],
                names=["key", "label", "lines", "lengths"])

    rows = write_table(spark, "quality_sample", sample(docs, labels, label, usable, bounds or BOUNDS))
    made = write_table(spark, "quality_lines", rows.mapInArrow(run, "key long, label int, lines binary, lengths binary")
                       .withColumn("h", F.xxhash64("lines")))
    own = ["key", "label", "h"]
    sizes = made.groupBy(*own).agg(F.sum(F.octet_length("lengths") / 4).alias("n")).where(F.col("n") * 10 <= most)
    fits = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("key"), *own)))  # sum(bounds) rows at most
    found = made.join(F.broadcast(fits.where(F.col("upto") <= most).select(*own)), own, "left_semi").drop("h").toPandas()
    found = found.sort_values("key", ignore_index=True)  # the same model whatever the partitions
    y = found.label.to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(3 * MEASURES), np.zeros((2, 2)), *logistic(np.zeros(len(y)), y))
    own = [np.frombuffer(b, "<f4").reshape(-1, MEASURES).astype(float) for b in found.lines]
    model = _fit_chain(own, y)
    x = []
    for lines, lengths in zip(own, found.lengths):
        size = np.frombuffer(lengths, "<f4").astype(float)
        mean = float(model.good(lines) @ size / size.sum())
        x.append(math.log((mean + 1e-3) / (1 - mean + 1e-3)))
    model.slope, model.intercept = logistic(np.array(x), y, ridge=1.0)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, good_lines, score) of every whole text; good_lines is `Model.quality`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            q = np.array([model.quality(t) for t in batch.column("text").to_pylist()])
            s = 1 / (1 + np.exp(-(model.slope * q + model.intercept)))
            yield pa.record_batch([batch.column("key"), pa.array(q), pa.array(s)], names=["key", "good_lines", "score"])

    return (keyed(docs, key, text).mapInArrow(run, "key long, good_lines double, score double")
            .withColumnRenamed("key", key))


def kept(docs: DataFrame, model: Model, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores `least` or more, with all their columns."""
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            q = np.array([model.quality(t or "") for t in batch.column(text).to_pylist()])
            s = 1 / (1 + np.exp(-(model.slope * q + model.intercept)))
            yield batch.filter(pa.array(s >= least))

    return docs.select(*[f"`{f}`" for f in fields]).mapInArrow(run, docs.schema)
