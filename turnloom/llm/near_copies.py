"""Groups of texts whose five-word shingles have a similarity of 0.8 or more, by SimHash and an exact check.

The fingerprint, its segment counts and the grid are those of `simhash`. Two sets of shingles with a
similarity of 0.8 have fingerprints some 10 bits apart, and up to 24 in rare cases. No grid over 64 bits
tells texts apart at that distance: a cell would hold a fixed share of all documents. So a document enters
two kinds of cells:

* links of the grid join at radius 3, each link a cell of its two fingerprints;
* 20 bands of six least values of seeded permutations of its shingles. A pair with a similarity of 0.8
  shares a band with a chance of 99.7 %, at 0.85 of 99.99 %.

In a cell the Manhattan distance of the segment counts, a lower bound, sorts out pairs beyond 24 bits,
then the Hamming distance does, and the exact similarity of the two sets of shingles decides. Distinct
sets meet, not documents: a group of copies of any number is one entry. Members of a cell that verified
links already join are not compared again, so a cell of m variants of one text takes m comparisons.

A cell beyond `block` members, or beyond `volume` shingles, is first dealt in blocks by a hash of member
and cell, each its own task; blocks differ from cell to cell, so variants of one text end in one component.
Then only members of different components are left to compare: in each crowded cell the members outside
its largest component meet all others, dealt as pairs of blocks. No pair of a cell is left out.

A set is known by 64 bits of its hash; among 10^9 different sets, two share them with a chance of 3 %.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import simhash
from turnloom.llm.common import keyed, partitions, small
from turnloom.llm.components import components
from turnloom.session import write_table

WIDTH = 5
SIMILAR = 80  # per cent
BANDS, VALUES = 20, 6
REACH = 24  # bits; 24 is four deviations beyond the mean distance of the shortest texts at SIMILAR
BLOCK = 1024
VOLUME = 1 << 21  # shingles of a block: 16 MB
_STEP = 1 << 13  # shingles whose permuted values are held at once
_RANDOM = np.random.Generator(np.random.PCG64(simhash.SEED))
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * VALUES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; fewer words make one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, seed = xxhash.xxh64_intdigest, simhash.SEED
    return np.unique(np.fromiter((digest(joined[a:b - 1], seed) for a, b in zip(starts.tolist(), ends.tolist())), "<u8"))


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def sketch(held: np.ndarray) -> tuple[int, np.ndarray]:
    """Fingerprint and band hashes of a set of shingles; an empty set has zero and no bands."""
    if not len(held):
        return 0, np.zeros(0, "<u8")
    counts = np.zeros(64, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, "<u8")
    for low in range(0, len(held), _STEP):
        part = held[low:low + _STEP]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        np.minimum(least, (_FACTORS[:, None] * _mixed(part)[None, :]).min(axis=1), out=least)
    mark = sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(held)))
    bands = [xxhash.xxh64_intdigest(least[i * VALUES:(i + 1) * VALUES].tobytes(), i) for i in range(BANDS)]
    return mark, np.array(bands, "<u8")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, "<u8").view("<i8"))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        nodes, marks, sizes, bands = [], [], [], []
        for text in batch.column("text").to_pylist():
            held = shingles(text)
            mark, band = sketch(held)
            nodes.append(xxhash.xxh64_intdigest(held.tobytes(), simhash.SEED))
            marks.append(mark), sizes.append(len(held)), bands.append(band.view("<i8"))
        yield pa.record_batch(
            [batch.column("key"), batch.column("digest"), _signed(nodes), _signed(marks), pa.array(sizes, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], names=["key", "digest", "node", "fp", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        held = [shingles(text).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("node"), pa.array(held, pa.binary())], names=["node", "held"])


def _alike(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    few, many = sorted((len(a), len(b)))
    if 100 * few < similar * many or not few:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(long, short), many - 1)
    both = int(np.count_nonzero(long[at] == short))
    return 100 * both >= similar * (few + many - both)


def _joined(nodes: np.ndarray, roots: np.ndarray, chief: np.ndarray, fps: np.ndarray, held: list[bytes],
            similar: int) -> tuple[list[int], list[int]]:
    """Verified links between members of one cell that no path joins yet. Chiefs are of one component."""
    counts = (fps & _EVEN) + ((fps >> np.uint64(1)) & _EVEN)  # two bits a segment: its set bits
    unary = (counts | (counts >> np.uint64(1))) & _EVEN
    unary |= ((counts >> np.uint64(1)) & _EVEN) << np.uint64(1)
    sets = [np.frombuffer(h, "<u8") for h in held]
    label = np.unique(roots, return_inverse=True)[1]
    found = ([], [])
    for i in np.flatnonzero(~chief).tolist():
        others = np.flatnonzero(label != label[i])
        near = others[np.bitwise_count(unary[others] ^ unary[i]) <= REACH]  # lower bound
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= REACH]
        for j in near.tolist():
            if label[j] != label[i] and (chief[j] or j > i) and _alike(sets[i], sets[j], similar):
                found[0].append(nodes[i])
                found[1].append(nodes[j])
                label[label == label[j]] = label[i]
    return found


_EVEN = np.uint64(0x5555555555555555)


def _verified(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal cell and part; a run may go over from one batch to the next."""
    rows: list[tuple] = []
    place = None

    def links() -> pa.RecordBatch:
        node, root, chief, fp, held = zip(*rows)
        u, v = _joined(np.array(node), np.array(root), np.array(chief), np.array(fp).view("<u8"), list(held), similar)
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in small(batches):
        columns = [batch.column(c).to_pylist() for c in ("cell", "part", "node", "root", "chief", "fp", "held")]
        for cell, part, *row in zip(*columns):
            if (cell, part) != place:
                if len(rows) > 1:
                    yield links()
                place, rows = (cell, part), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield links()


def _links(spark: SparkSession, placed: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links among rows (cell, part, node, root, chief) that meet in one part of a cell."""
    return (placed.join(sets, "node").select("cell", "part", "node", "root", "chief", "fp", "held")
            .repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "node")
            .mapInArrow(lambda b: _verified(b, similar), "u long, v long").distinct())


def _cells(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(cell, node, members, blocks): cells of two or more sets; of cells with equal members one."""
    grid = simhash.links(spark, nodes.select(F.col("fp").alias("fingerprint")).distinct())
    linked = grid.select(F.xxhash64("u", "v").alias("cell"), F.explode(F.array("u", "v")).alias("fp"))
    entries = write_table(spark, "entries", nodes.select(F.explode("bands").alias("cell"), "node", "size").unionByName(
        linked.join(nodes, "fp").select("cell", "node", "size")).unionByName(
        nodes.select(F.xxhash64("fp").alias("cell"), "node", "size")))
    told = entries.groupBy("cell").agg(F.count("*").alias("members"), F.sum("size").alias("volume"),
                                       F.bit_xor(F.xxhash64("node")).alias("a"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"))
    chosen = told.where("members > 1").groupBy("members", "a", "b").agg(
        F.min("cell").alias("cell"), F.min("volume").alias("volume"))
    return entries.join(chosen, "cell").select("cell", "node", "size", "members", "volume")


def _rest(spark: SparkSession, crowded: DataFrame, found: DataFrame, block: int, volume: int) -> DataFrame:
    """Members of crowded cells that still have to meet: those outside a cell's largest component are
    dealt with all others in pairs of blocks (a, b), b a block of those outside."""
    roots = components(spark, found)
    held = write_table(spark, "crowded", crowded.join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")).select("cell", "node", "size", "root"))
    sizes = held.groupBy("cell", "root").agg(F.count("*").alias("n"))
    chiefs = sizes.groupBy("cell").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count("*").alias("parts"))
    sided = held.join(chiefs.where("parts > 1"), "cell").withColumn("chief", F.col("root") == F.col("top"))
    n = lambda chief: F.coalesce(F.greatest(  # noqa: E731  blocks of one side
        F.ceil(F.count(F.when(F.col("chief") == chief, 1)) / block),
        F.ceil(F.sum(F.when(F.col("chief") == chief, F.col("size"))) / volume)), F.lit(1)).cast("long")
    told = sided.groupBy("cell").agg(n(True).alias("x"), n(False).alias("y"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("chief"), F.col("x")).otherwise(F.col("y")))
    zero = F.lit(0).cast("long")
    # parts: x * y of a block of chiefs with one outside, then y * y of two blocks outside, the lesser first
    mixed = lambda a, b: a * F.col("y") + b
    inner = lambda a, b: F.col("x") * F.col("y") + F.least(a, b) * F.col("y") + F.greatest(a, b)
    below = lambda c: F.sequence(zero, F.col(c) - 1)
    parts = F.when(F.col("chief"), F.transform(below("y"), lambda b: mixed(own, b))).otherwise(
        F.concat(F.transform(below("x"), lambda a: mixed(a, own)), F.transform(below("y"), lambda b: inner(own, b))))
    return sided.join(told, "cell").select("cell", F.explode(parts).alias("part"), "node", "root", "chief")


def grouped(spark: SparkSession, docs: DataFrame, key: str = "key", text: str = "text", digest: str = "digest",
            similar: int = SIMILAR, block: int = BLOCK, volume: int = VOLUME) -> DataFrame:
    """(key, digest, root) of every row of docs (key, text, digest): rows of one root form a group.

    Texts without words form one group, equal words another, whatever their case of A-Z and white space.
    Null texts are empty. Repeated rows give repeated rows; an empty table gives an empty table.
    """
    texts = keyed(docs, key, text, True, [F.col(digest).alias("digest")])
    marks = write_table(spark, "sketches", texts.mapInArrow(
        _sketches, "key long, digest string, node long, fp long, size long, bands array<long>"))
    nodes = write_table(spark, "nodes", marks.groupBy("node").agg(
        F.min(F.struct("key", "digest")).alias("of"), *[F.any_value(c).alias(c) for c in ("fp", "size", "bands")]))
    cells = write_table(spark, "cells", _cells(spark, nodes))
    wanted = nodes.join(cells.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("of.key").alias("of_key"), F.col("of.digest").alias("of_digest"))
    chosen = texts.join(wanted, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("digest") == F.col("of_digest")))
    held = chosen.select("node", "text").mapInArrow(_sets, "node long, held binary").dropDuplicates(["node"])
    sets = write_table(spark, "sets", held.join(nodes.select("node", "fp"), "node"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("volume") / volume), F.lit(1))
    part = F.pmod(F.xxhash64("node", "cell"), blocks.cast("long"))
    placed = cells.select("cell", part.alias("part"), "node", F.col("node").alias("root"), F.lit(False).alias("chief"))
    found = write_table(spark, "verified", _links(spark, placed, sets, similar))
    more = _rest(spark, cells.where(blocks > 1), found, block, volume)
    found = found.unionByName(write_table(spark, "verified", _links(spark, more, sets, similar)))
    return marks.join(components(spark, found), "node", "left").select(
        "key", "digest", F.coalesce("root", "node").alias("root"))


def one_of_each(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text",
                similar: int = SIMILAR, block: int = BLOCK, volume: int = VOLUME) -> DataFrame:
    """One row of each group, chosen as by `simhash.one_of_each`: the least key, of its rows the least text
    digest, of equal ones the least hash. Rows with a null key take no part and all stay. All columns of the
    input, of any name, and no others come back."""
    texts = docs.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), simhash.digest_of(text).alias("digest"))
    rooted = grouped(spark, texts, "key", "text", "digest", similar, block, volume)
    rows = rooted.groupBy("root", "key", "digest").agg(F.count("*").alias("n"))
    return simhash.first_rows(spark, docs, rows, key, text)
