"""SimHash near-duplicates found by a grid join over segment popcounts.

A 64-bit fingerprint is embedded as the set-bit counts (0, 1, 2) of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance, so fingerprints within
radius 3 are within Manhattan distance 3. The 32 segments form 6 groups: at distance 3 at least three
groups agree in every count, so each distinct fingerprint enters 20 grid cells (a choice of three
groups and their counts), and near fingerprints share a cell. Inside a cell the Manhattan bound
sorts out most pairs, the exact Hamming distance decides, and only a spanning forest of the links
leaves the cell: never all pairs.

Counts are kept in unary (0 -> 00, 1 -> 01, 2 -> 11), so that a Manhattan distance is one XOR and
one popcount.

Exact copies share a fingerprint and meet before the grid, so a group of any number of copies is one
entry. A cell with more than `block` fingerprints is dealt out as pairs of blocks, each its own task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import keyed, partitions, small
from turnloom.llm.components import components
from turnloom.session import write_table

SEED = 42
RADIUS = 3
BLOCK = 2048
_STEP = 1 << 15  # shingles whose bits are counted at once
_BOUNDS = (0, 5, 10, 15, 20, 26, 32)  # segments of the six groups
_EVEN = 0x5555555555555555


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the `width`-word shingles of one UTF-8 text, as an unsigned integer."""
    words = text.lower().split()  # A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) >= width:
        starts, ends = starts[:len(words) - width + 1].tolist(), (ends[width - 1:] - 1).tolist()
    else:
        starts, ends = [0], [len(joined)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, len(starts), _STEP):
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[low:low + _STEP], ends[low:low + _STEP])),
            "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(starts))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
                 more: list[Column] | None = None) -> DataFrame:
    """(key, fingerprint: long) of every whole text, and `more`; a text without words, or null, has zero."""
    rows = keyed(docs, key, text, True, more)
    extra = [f for f in rows.schema.fields if f.name not in ("key", "text")]
    schema = ", ".join(["key long, fingerprint long", *[f"{f.name} {f.dataType.simpleString()}" for f in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            marks = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], "<u8")
            yield pa.record_batch([batch.column("key"), pa.array(marks.view("<i8")), *[batch.column(f.name) for f in extra]],
                                  names=["key", "fingerprint", *[f.name for f in extra]])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def unary(x: Column) -> Column:
    """Segment counts in unary: the lower bit of a segment says one or more, the upper one says two."""
    low, high = F.lit(_EVEN), F.shiftrightunsigned(x, 1)
    return (x.bitwiseOR(high)).bitwiseAND(low).bitwiseOR(
        F.shiftleft(x.bitwiseAND(high).bitwiseAND(low), 1))


def _masks() -> list[int]:
    groups = [sum(3 << (2 * s) for s in range(a, b)) for a, b in itertools.pairwise(_BOUNDS)]
    return [_signed(sum(chosen)) for chosen in itertools.combinations(groups, 3)]


def cells(marks: DataFrame) -> DataFrame:
    """(cell, counts, fp): each distinct fingerprint once in each of its 20 grid cells."""
    held = marks.select(F.col("fingerprint").alias("fp"), unary(F.col("fingerprint")).alias("counts"))
    places = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m)))
                       for i, m in enumerate(_masks())])
    return held.select(F.explode(places).alias("cell"), "counts", "fp")


def _forest(fps: np.ndarray, counts: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links inside one cell: every found node points to the one before it."""
    left, found = np.arange(len(fps)), ([], [])
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count(counts[left] ^ counts[node]) <= radius  # lower bound
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[node]) <= radius
            for hit in left[near].tolist():
                found[0].append(hit)
                found[1].append(node)
                front.append(hit)
            left = left[~near]
    return found


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal cells; a run may go over from one batch to the next."""
    signed = lambda x: pa.array(np.concatenate(x).view("<i8"))
    kept = None
    for batch in itertools.chain(batches, [None]):
        columns = None if batch is None else [
            np.concatenate([k, c]) if kept is not None else c
            for k, c in zip(kept or [None] * 4, [batch.column(i).to_numpy().view("<u8") for i in range(4)])]
        if columns is None:
            if kept is None:
                return
            columns, kept = kept, None
        cell, part, counts, fps = columns
        if not len(cell):
            continue
        turn = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        edges = np.concatenate(([0], turn, [len(cell)]))
        if batch is not None:
            kept = [c[edges[-2]:] for c in columns]
            edges = edges[:-1]
        if len(edges) < 2:
            continue
        size = np.diff(edges)
        left, right = [], []
        two = edges[:-1][size == 2]
        near = np.bitwise_count(counts[two] ^ counts[two + 1]) <= radius
        two = two[near]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        left.append(fps[two]), right.append(fps[two + 1])
        for at, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
            u, v = _forest(fps[at:at + n], counts[at:at + n], radius)
            left.append(fps[at:at + n][u]), right.append(fps[at:at + n][v])
        yield pa.record_batch([signed(left), signed(right)], names=["u", "v"])


def links(spark: SparkSession, marks: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all pairs at `radius` or fewer
    differing bits; pairs that a path already joins may be left out."""
    if not 0 <= radius <= 3:
        raise ValueError("six groups serve a radius of 3 at most")
    placed = cells(marks)
    crowded = (placed.groupBy("cell").count().where(F.col("count") > block)
               .select("cell", F.ceil(F.col("count") / block).cast("long").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = placed.join(crowded, "cell", "left").select(
        "cell", "counts", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long")))
        .otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                               lambda b: F.least(own, b) * F.col("blocks") + F.greatest(own, b)))
        ).alias("part"))
    return (dealt.select("cell", "part", "counts", "fp")
            .repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part")
            .mapInArrow(lambda b: _linked(b, radius), "u long, v long").distinct())


def groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text",
           width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component): component is the least key reachable through links.

    A null key is no member of a component's minimum; if all keys of a component are null its id is
    null. Texts without words share fingerprint zero and are linked like any others. Repeated rows
    give repeated rows; an empty table gives an empty table.
    """
    marks = write_table(spark, "fingerprints", fingerprints(docs, key, text, width))
    return marks.join(_named(spark, marks, key, radius), "fingerprint").select(key, "fingerprint", "component")


def _named(spark: SparkSession, marks: DataFrame, key: str, radius: int) -> DataFrame:
    """(fingerprint, root, component): of each component a fingerprint and the least key."""
    least = write_table(spark, "marks", marks.groupBy("fingerprint").agg(F.min(key).alias("low")))
    roots = components(spark, links(spark, least, radius))
    held = least.join(roots, least.fingerprint == roots.node, "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    named = held.join(held.groupBy("root").agg(F.min("low").alias("component")), "root")
    return named.select("fingerprint", "root", "component")


def one_of_each(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
                radius: int = RADIUS) -> DataFrame:
    """One row of each component: the least key, of its rows the least text digest, and of rows equal in
    both the one whose other columns have the least hash. So a text goes only if its component keeps
    another row, whatever keys it shares. Rows with a null key all stay. The input's columns travel as one
    struct, so none can clash; columns of maps count for nothing in that hash."""
    digest = digest_of(text)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), digest.alias("digest"))
    marks = write_table(spark, "fingerprints", fingerprints(texts, "key", "text", width, [F.col("digest")]))
    named = _named(spark, marks, "key", radius)
    rows = marks.where("key IS NOT NULL").groupBy("fingerprint", "key", "digest").agg(F.count("*").alias("n"))
    return first_rows(spark, docs, rows.join(named, "fingerprint").select("root", "key", "digest", "n"), key, text)


def digest_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)


def first_rows(spark: SparkSession, docs: DataFrame, rooted: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs without all but the first of each root; rooted has (root, key, digest, n: rows)."""
    digest = digest_of(text)
    placed = write_table(spark, "placed", rooted)
    chosen = placed.groupBy("root").agg(F.min(F.struct("key", "digest")).alias("c"))
    marked = write_table(spark, "marked", placed.join(chosen, "root").select(
        "key", "digest", "n", (F.struct("key", "digest") == F.col("c")).alias("stays")))
    given = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("given"),
                        F.col(f"`{key}`").cast("long").alias("key"), digest.alias("digest"))
    # all others stay as they are; a join that takes rows away needs no shuffle of texts where few go
    single = given.join(marked.where("NOT stays OR n > 1").select("key", "digest"), ["key", "digest"], "left_anti")
    again = marked.where("stays AND n > 1").select("key", "digest")
    plain = [f"given.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    repeated = given.join(again, ["key", "digest"]).groupBy("key", "digest").agg(
        F.min_by("given", F.xxhash64(*plain)).alias("given"))
    return single.select("given").unionByName(repeated.select("given")).select("given.*")
