"""Nearest neighbours by inner product through multi-index hashing of learned binary codes.

Vectors are scaled and given one more component so that the inner product order is the cosine order
(the component is zero when all norms are equal), then rotated to binary codes by iterative
quantisation: several rotations of the principal axes learned on a bounded sample. Codes are split
into substrings, each indexed by its values. Codes within Hamming distance r agree to within
floor(r / substrings) bits in at least one substring, so probing each substring's table within that
distance retrieves every code within the radius (pigeonhole); the full distance then sorts out the
rest and the original vectors rank what remains, in double precision.

The radius is learned on the sample: the least that holds `target` of the sampled queries' true
neighbours. A query that finds fewer than it should is searched again with all codes in reach.

Work is dealt out as pairs of an index block and a query block, both of bounded size, so no task
holds an unbounded group. Equal vectors are one entry of the index and one query; of their ids the
k + 1 least are kept, which is all that k answers without the query itself can show.

Defined results: vectors that are null, all zero, of another length than most, or that hold a null or
non-finite component take no part; ties go to the smaller id; of rows that repeat an id the
least vector counts; an empty table gives no rows; fewer than k candidates give all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.session import write_table

SAMPLE = 20_000
ROTATIONS, WORD, TARGET = 4, 16, 0.965
INDEX_ROWS, QUERY_ROWS = 32_768, 2_048
_CHECKED = 256  # sampled queries that the radius is learned from


@dataclass
class Codes:
    """How vectors become codes: `rotation` has one column per bit."""

    rotation: np.ndarray
    largest: float
    radius: int = 0

    @property
    def words(self) -> int:
        return self.rotation.shape[1] // WORD

    def _packed(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1).view(np.uint16)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return self._packed(np.hstack([x, rest[:, None]]))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._packed(np.hstack([x, np.zeros((len(x), 1))]))


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def learn(x: np.ndarray, largest: float, k: int, rotations: int = ROTATIONS, target: float = TARGET,
          seed: int = 7) -> Codes:
    """Codes and radius from a sample; its order and `seed` settle everything random."""
    rng = np.random.default_rng(seed)
    scaled = x / largest
    full = np.hstack([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(1)))[:, None]])
    width = full.shape[1]
    bits = max(WORD, WORD * (width // WORD))  # a rotation's leading axes, in whole substrings
    _, axes = np.linalg.eigh(full.T @ full)
    axes = axes[:, ::-1][:, :min(bits, width)]
    if axes.shape[1] < bits:  # short vectors: more directions than axes
        axes = np.hstack([axes, rng.normal(size=(width, bits - axes.shape[1]))])
    parts = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        spread = full @ axes
        for _ in range(25):
            u, _, v = np.linalg.svd(np.where(spread @ turn > 0, 1.0, -1.0).T @ spread)
            turn = (u @ v).T
        parts.append(axes @ turn)
    codes = Codes(np.hstack(parts), largest)
    asked = rng.permutation(len(x))[:_CHECKED]
    index, seen = codes.of_rows(x), []
    for i, code in zip(asked, codes.of_queries(x[asked])):
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else []
        seen.append(distances(index[best], code))
    seen = np.sort(np.concatenate(seen)) if seen else np.zeros(0)
    codes.radius = int(seen[min(len(seen) - 1, math.ceil(target * len(seen)))]) if len(seen) else 0
    return codes


class Index:
    """One block of codes: for each substring, its distinct values and each row's place among them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within `radius`, by probing every substring's table."""
        reach = radius // len(self.tables)
        hit = np.zeros(len(self.codes), bool)
        for (values, place), own in zip(self.tables, code):
            hit |= (np.bitwise_count(values ^ own) <= reach)[place]
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], code) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _search(index: DataFrame, queries: DataFrame, codes: Codes, k: int) -> DataFrame:
    """(query, rep, score): per query and index block the k + 1 best distinct vectors in the radius."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            order = np.argsort(left["rep"].to_numpy())
            reps, x = left["rep"].to_numpy()[order], _matrix(left["vector"])[order]
            table, asked = Index(codes.of_rows(x)), _matrix(right["vector"])
            for name, query, code in zip(right["rep"].to_numpy(), asked, codes.of_queries(asked)):
                rows = table.within(code, codes.radius)
                near = np.einsum("ij,j->i", x[rows], query)
                if len(rows) > k + 1:  # rows are in the order of their id, which settles ties
                    best = np.lexsort((rows, -near))[:k + 1]
                    rows, near = rows[best], near[best]
                out[0].append(np.full(len(rows), name)), out[1].append(reps[rows]), out[2].append(near)
        arrays = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({n: pa.array(a, t) for n, a, t in zip(
            ("query", "rep", "score"), (arrays[0].astype("<i8"), arrays[1].astype("<i8"), arrays[2]),
            (pa.int64(), pa.int64(), pa.float64()))})

    return index.groupBy("ib", "qb").cogroup(queries.groupBy("ib", "qb")).applyInArrow(
        run, "query long, rep long, score double")


def _blocks(rows: DataFrame, n: int, own: str, others: int, other: str) -> DataFrame:
    """Each row in its own block, once for every block of the other side."""
    return rows.select("rep", "vector", F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int").alias(own),
                       F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score): for each row that `is_query` (over `vectors`) admits, its k best."""
    x = F.col("vector")
    raw = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), is_query.alias("asks"),
                         F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(
        "id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(x, lambda v: v != 0))
    sizes = raw.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id long, rank int, {key} long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    ids = raw.where(F.size("vector") == sizes.d).groupBy("id").agg(F.min(F.struct("vector", "asks")).alias("r")).select(
        "id", "r.asks", "r.vector")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    distinct = write_table(spark, "vectors", ids.groupBy("vector").agg(
        F.min("id").alias("rep"), F.max("asks").alias("asks"), F.max(norm).alias("norm")))
    totals = distinct.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"),
                          F.max("norm").alias("largest")).first()
    if not totals.q:
        return spark.createDataFrame([], schema)
    drawn = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()
    codes = learn(np.array(drawn.vector.tolist(), float), totals.largest, k)

    n_index, n_query = -(-totals.n // INDEX_ROWS), -(-totals.q // QUERY_ROWS)
    queries = distinct.where("asks")
    enough = min(k + 1, totals.n)
    found = write_table(spark, "near", _search(
        _blocks(distinct, n_index, "ib", n_query, "qb"), _blocks(queries, n_query, "qb", n_index, "ib"), codes, k))
    short = write_table(spark, "short", queries.join(
        found.groupBy("query").count().where(F.col("count") >= enough), F.col("rep") == F.col("query"), "left_anti"))
    if short.limit(1).count():
        again = Codes(codes.rotation, codes.largest, codes.rotation.shape[1])
        found = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(write_table(
            spark, "near", _search(_blocks(distinct, n_index, "ib", n_query, "qb"),
                                   _blocks(short, n_query, "qb", n_index, "ib"), again, k)))

    # equal vectors: of each the least k + 1 ids, then of each query vector the best k + 1 rows
    few = Window.partitionBy("vector").orderBy("id")
    copies = ids.select("id", "vector").distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).join(
        distinct.select("vector", "rep"), "vector").select("rep", "id")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).join(copies, "rep")
    rows = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = (top.withColumn("n", F.row_number().over(rows)).where(F.col("n") <= k + 1).groupBy("query")
             .agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best")))
    members = ids.where("asks").select("vector", F.col("id").alias("query_id")).distinct().join(
        distinct.select("vector", "rep"), "vector").select("query_id", "rep")
    others = F.slice(F.filter("best", lambda b: b.id != F.col("query_id")), 1, k)
    return members.join(lists, members.rep == lists.query).select(
        "query_id", F.posexplode(others).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias(key), F.col("b.score").alias("score"))
