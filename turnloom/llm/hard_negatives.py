"""Hard negatives by exact integer inner products, several candidates to one multiplication.

Components become integers (`floor(256 x)`). `Packed` makes the components of several candidates
non-negative by a bias and lays them side by side into the fields of one wide integer, a field being
wide enough for a whole biased inner product. One multiplication by an anchor's (biased) component then
serves all candidates of the integer; after the sum over components each field holds the biased product
of one candidate, and what the biases added is taken off again. A wide integer is the 53 exact bits of
a double where two fields or more fit in, so that matrix multiplication does the work (every partial sum
is a whole number below 2^53, so it is exact in any order); else it is a Python integer of `WIDE` fields.

Two searches deal out pairs of an index block and an anchor block, both of bounded size:

1. each anchor's best rows of its own label; a label beyond a block is split, small ones share blocks;
2. for each of these positives the best rows of other labels inside its band of scores.

Each pair of blocks yields at most a few rows an anchor; a window then takes the best of all blocks.
Every row is moved once for each anchor block and every anchor once for each index block.

Defined results: rows with a null id or label, a null or empty vector, or a null or non-finite component
take no part, nor do components so large that a score might not fit a long (beyond sqrt(2^55 / length)
after scaling). Rows of different vector lengths are never partners. Rows that repeat an id count as one,
with the least label, then the least vector. Ties go to the smaller id. Other columns are not read; an
empty table gives no rows; an anchor without positives, or a positive without negatives, gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.session import write_table

SCALE = 256
INDEX_ROWS, ANCHOR_ROWS = 8_192, 16_384
WIDE = 512  # fields of a Python integer
_PAIRS = 1 << 21  # scores held at once


class Packed:
    """Candidates' integer components, packed for anchors whose components lie in [low, high]."""

    def __init__(self, x: np.ndarray, low: int, high: int, exact_bits: int = 53):
        self.n, self.length = x.shape
        self.low, self.bias = low, int(x.min())
        lifted = x - self.bias
        self.sums = lifted.sum(1)
        self.width = max(1, (self.length * int(lifted.max()) * (high - low)).bit_length())
        self.fields = exact_bits // self.width
        if self.fields >= 2:
            padded = np.zeros((-(-self.n // self.fields) * self.fields, self.length), np.int64)
            padded[:self.n] = lifted
            shifts = self.width * np.arange(self.fields)
            self.words = (padded.reshape(-1, self.fields, self.length) << shifts[:, None]).sum(1).astype(float).T
        else:
            self.words = [[int.from_bytes(np.ascontiguousarray(part[:, j], "<u8").tobytes(), "little")
                           for j in range(self.length)]
                          for part in (lifted[i:i + WIDE] for i in range(0, self.n, WIDE))]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, one row per anchor and one column per candidate."""
        lifted = anchors - self.low
        if self.fields >= 2:
            wide = (lifted.astype(float) @ self.words).astype(np.int64)
            mask = (1 << self.width) - 1
            parts = [(wide >> self.width * k) & mask for k in range(self.fields)]
            biased = np.stack(parts, 2).reshape(len(anchors), -1)[:, :self.n]
        else:
            biased = np.empty((len(anchors), self.n), np.int64)
            for row, own in zip(biased, lifted.tolist()):
                for i, words in enumerate(self.words):
                    size = min(WIDE, self.n - i * WIDE)
                    total = sum(a * w for a, w in zip(own, words))
                    row[i * WIDE:i * WIDE + size] = np.frombuffer(total.to_bytes(8 * size, "little"), "<u8")
        return (biased + self.bias * lifted.sum(1)[:, None] + self.low * self.sums[None, :]
                + self.length * self.low * self.bias)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _ranked(allowed: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all allowed pairs, by row, falling score and column."""
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    return row[order], column[order]


def _positives(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's best k allowed pairs."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (masked >= np.partition(masked, -k, axis=1)[:, -k, None])
    row, column = _ranked(allowed, scores)
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def _negatives(scores: np.ndarray, other: np.ndarray, positives: list[np.ndarray], low: int, high: int,
               k: int) -> list[tuple[int, int, int]]:
    """(row, number of the positive, column): the best k allowed pairs inside each positive's band."""
    top = np.array([p.max(initial=-1) for p in positives])
    least = np.array([p.min(initial=0) for p in positives])
    floor = -((-low * least) // 100)
    row, column = _ranked(other & (scores <= (high * top // 100)[:, None]) & (scores >= floor[:, None]), scores)
    falling = -scores[row, column]
    edges = np.searchsorted(row, np.arange(len(positives) + 1))
    found = []
    for i in np.unique(row):
        own = falling[edges[i]:edges[i + 1]]
        for number, p in enumerate(positives[i].tolist()):
            start = np.searchsorted(own, -(high * p // 100), "left")
            end = np.searchsorted(own, low * p // -100, "right")
            found += [(i, number, column[edges[i] + at]) for at in range(start, min(start + k, end))]
    return found


def _dealt(rows: DataFrame, own: list[Column], others: Column, name: str, more: list[str]) -> DataFrame:
    """Rows with their block, once for every block of the other side."""
    fresh = [F.col(c).alias(c) for c in ("id", "label", "x", *more)]  # both sides may come from one table
    return rows.select(*fresh, *own, F.explode(F.sequence(F.lit(0), others - 1)).alias(name))


def _search(index: DataFrame, anchors: DataFrame, keys: list[str], schema: str, choose) -> DataFrame:
    """`choose(scores, ids, whether labels agree, anchors' rows)` over slices of every pair of blocks."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            ids = left["id"].to_numpy()
            every = pa.chunked_array([*left["label"].chunks, *right["label"].chunks]).combine_chunks()
            labels = every.dictionary_encode().indices.to_numpy()  # numbers compare faster than texts
            labels, asked = labels[:len(ids)], labels[len(ids):]
            x, a = _matrix(left["x"], left.num_rows), _matrix(right["x"], right.num_rows)
            packed = Packed(x, int(a.min()), int(a.max()))
            step = max(1, _PAIRS // len(ids))
            for at in range(0, len(a), step):
                for column, values in zip(found, choose(
                        packed.scores(a[at:at + step]), ids, asked[at:at + step, None] == labels, right.slice(at, step))):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int32() if f.endswith(" int") else pa.int64())
                         for c, f in zip(found, schema.split(", "))], names=names)

    return index.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(run, schema)


def _best(found: DataFrame, by: list[str], id_: str, score: str, k: int) -> DataFrame:
    rows = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(rows)).where(F.col("rank") <= k)


def integer_rows(vectors: DataFrame, is_anchor: Column, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, x, d, asks): one row per id that takes part."""
    raw = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                         F.col(f"`{vector}`").cast("array<double>").alias("v"), is_anchor.alias("asks"))
    fits = raw.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c)
                 & (F.abs(c) * scale < F.sqrt(F.lit(float(1 << 55)) / F.size("v")) - 1)))
    whole = fits.select("id", "label", "asks", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))
    return whole.groupBy("id").agg(F.min(F.struct("label", "x", "asks")).alias("r")).select(
        "id", "r.label", "r.x", F.size("r.x").alias("d"), F.coalesce("r.asks", F.lit(False)).alias("asks"))


def mine(spark: SparkSession, vectors: DataFrame, is_anchor: Column, key: str = "vec_id",
         vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, scale: int = SCALE, index_rows: int = INDEX_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and
    each of its best `positives` rows of the same label, the best `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score."""
    rows = write_table(spark, "integer_rows", integer_rows(vectors, is_anchor, key, vector, label, scale))
    asks = F.col("asks").cast("long")
    few = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")

    # 1. positives: blocks by label
    sizes = rows.groupBy("d", "label").agg(F.count("*").alias("n"), F.sum(asks).alias("q")).where("q > 0")
    shared = sizes.where(F.col("n") <= index_rows).agg(F.sum("n")).first()[0] or 0
    homes = F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(shared / index_rows)))).cast("string")
    sizes = sizes.select("d", "label", few(F.col("n"), index_rows).alias("parts"), few(F.col("q"), anchor_rows).alias("lots"),
                         F.when(F.col("n") <= index_rows, F.concat(F.lit("s"), homes)).otherwise(
                             F.concat(F.lit("l"), "label")).alias("home"))
    placed = rows.join(sizes, ["d", "label"])
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    lot = F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot")
    own = [F.col("d").alias("d"), F.col("home").alias("home")]

    def same_label(scores, ids, same, anchors):
        names = anchors["id"].to_numpy()
        r, c = _positives(scores, same & (names[:, None] != ids), positives)
        return names[r], ids[c], scores[r, c]

    keys = ["d", "home", "part", "lot"]
    first = _search(_dealt(placed, [*own, part], F.col("lots"), "lot", []),
                    _dealt(placed.where("asks"), [*own, lot], F.col("parts"), "part", []),
                    keys, "anchor_id long, positive_id long, positive_score long", same_label)
    best = write_table(spark, "positives", _best(first, ["anchor_id"], "positive_id", "positive_score", positives)
                       .where("positive_score >= 0").drop("rank"))  # no score lies in a negative one's band

    # 2. negatives: blocks by id
    totals = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum(asks).alias("q")).select(
        "d", few(F.col("n"), index_rows).alias("parts"), few(F.col("q"), anchor_rows).alias("lots"))
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "positive_score", "positive_id"))).alias("wanted"))
    asking = rows.where("asks").join(lists, F.col("id") == F.col("anchor_id")).join(totals, "d")

    def in_band(scores, ids, same, anchors):
        names = anchors["id"].to_numpy()
        wanted = anchors["wanted"].to_pylist()
        bands = [np.array([w["positive_score"] for w in ws], np.int64) for ws in wanted]
        found = _negatives(scores, ~same, bands, low, high, negatives)
        return ([names[r] for r, _, _ in found], [wanted[r][p]["positive_id"] for r, p, _ in found],
                [ids[c] for _, _, c in found], [wanted[r][p]["positive_score"] for r, p, _ in found],
                [scores[r, c] for r, _, c in found])

    second = _search(_dealt(rows.join(totals, "d"), [own[0], part], F.col("lots"), "lot", []),
                     _dealt(asking, [own[0], lot], F.col("parts"), "part", ["wanted"]),
                     ["d", "part", "lot"],
                     "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", in_band)
    return _best(second, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")
