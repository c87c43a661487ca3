"""Best-fit packing of token sequences by large-item matching over a histogram of lengths.

Lengths are whole numbers up to the capacity, so the packing is planned on their histogram: at most
`capacity` counts, whatever the number of documents. Pieces above a third of the capacity go at most
two to a sequence and are matched greedily, the longest with the longest that fits; shorter pieces
then fill the tightest gap, longest first. The plan says which ranks of each length go where, and
every row finds its place by its rank among the pieces of its length. Ranks are counted per chunk of
rows and offset by the counts of the chunks before, so no task sees a whole length class.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import keyed, small
from turnloom.session import write_table

CAPACITY = 2048
CACHED = 500_000  # words a worker remembers, in each of two generations

# Characters that normalisation leaves alone but for lower case: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = "a-zß-öø-ÿ"
# The pre-tokeniser's pattern over that alphabet, after lower-casing.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordIds(dict):
    """Ids of a text through a `tokenizers` file, remembering the ids of words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words in order. A word over the plain alphabet goes straight to the tokenizer's model, part by
    part; any other, and one that holds an added token's string (which has its own id, as by the
    library's default), goes through the whole tokenizer. `plain=False` always takes the latter.
    """

    def __init__(self, file: str, cached: int = CACHED, plain: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(file)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.content.split() != [t.content] for t in added):
            raise ValueError("an added token reaches beyond a word or is matched after normalisation")
        self.added = [t.content for t in added]
        self.tokenize = self.tokenizer.model.tokenize
        self.cached, self.plain = cached, plain
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {n: level.pre_tokenize_str(chr(n))[0][0] for n in range(0xC0, 0x100)}
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._word(word)
        self[word] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not self.plain or not _PLAIN.fullmatch(text) or any(a in text for a in self.added):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        lower = text.lower()
        parts = _PARTS.findall(lower)
        if len(parts) > 1 or lower != text:  # a part is a word of its own, in lower case
            return b"".join([self[part.encode()] for part in parts])
        tokens = self.tokenize(text if text.isascii() else text.translate(self.shown))
        return _packed([t.id for t in tokens])

    def __call__(self, text: bytes) -> bytes:
        ids = b"".join(map(self.__getitem__, text.split()))  # ASCII white space
        if len(self) > self.cached:
            self.old = dict(self)
            self.clear()
        return ids


def _packed(ids: list[int]) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


_IDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end: int = 0,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: its ids and then `end`, cut only where longer than `capacity`.

    (key, piece, start, length, ids_crc32, chunk, rank): rank counts the pieces of that length
    before this one in the chunk, which is one task's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _IDS.setdefault(tokenizer_file, WordIds(tokenizer_file))
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for batch in small(batches):
            rows = []
            for name, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(ids_of(body) + last)
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((name, i, at // 4, n, zlib.crc32(part), chunk, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return keyed(docs, key, text, binary=True).mapInArrow(
        run, "key long, piece int, start long, length long, ids_crc32 long, chunk long, rank long"
    ).withColumnRenamed("key", key)


_NAMES = ["key", "piece", "start", "length", "ids_crc32", "chunk", "rank"]
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank, sequence, per, offset): from `rank` on, pieces of `length` lie `per` to a
    sequence, from `sequence` on, the first at `offset`. At most a few rows for each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, placed = np.zeros(capacity + 1, np.int64), []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    made = 0

    def put(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        placed.append((length, int(used[length]), sequence, per, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            mate = min(capacity - length, length)
            while mate > third and not left[mate]:
                mate -= 1
            if mate <= third:
                n, rest = int(left[length]), capacity - length
                put(length, n, made, 1, 0)
            elif mate == length and left[length] > 1:
                n, rest = int(left[length]) // 2, capacity - 2 * length
                put(length, 2 * n, made, 2, 0)
            elif mate == length:  # a single one: its mate is shorter
                mate -= 1
                while mate > third and not left[mate]:
                    mate -= 1
                n, rest = 1, capacity - length - (mate if mate > third else 0)
                put(length, 1, made, 1, 0)
                if mate > third:
                    put(mate, 1, made, 1, length)
            else:
                n, rest = int(min(left[length], left[mate])), capacity - length - mate
                put(length, n, made, 1, 0)
                put(mate, n, made, 1, length)
            gaps[rest].append((made, n))
            made += n
    for length in range(third, 0, -1):
        while n := int(left[length]):
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), 0)
            if not gap:
                gap, per = capacity, capacity // length
                gaps[gap].append((made, -(-n // per)))
                made += -(-n // per)
            sequence, bins = gaps[gap].pop()
            per = gap // length
            full = min(bins, n // per)
            if full:
                put(length, full * per, sequence, per, capacity - gap)
                gaps[gap - per * length].append((sequence, full))
            if full < bins:
                over = n - full * per  # fewer than `per`
                if over:
                    put(length, over, sequence + full, per, capacity - gap)
                    gaps[gap - over * length].append((sequence + full, 1))
                    full += 1
                if full < bins:
                    gaps[gap].append((sequence + full, bins - full))
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY,
         end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A null or empty text is the single id `end`; repeated rows and rows with a null key are packed
    like any others; an empty table gives an empty table; other columns are not read. Equal lengths
    are placed in the order of their rank, which settles ties.
    """
    cut = write_table(spark, "pieces", pieces(docs, tokenizer_file, capacity, end, key, text))
    counts = cut.groupBy("length", "chunk").count()
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_table(spark, "offsets", counts.withColumn(
        "first", F.coalesce(F.sum("count").over(before), F.lit(0))))
    totals = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps = plan(totals, capacity)  # one row for each length in `totals` at most, before planning

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.searchsorted(steps[:, 0], np.arange(capacity + 2))
        shift = int(steps[:, 1].max(initial=0)) + 1  # ranks of all lengths on one line
        line = steps[:, 0] * shift + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "place"))
            # a rank beyond the last step of its length stays with that step
            at = np.minimum(np.searchsorted(line, length * shift + np.minimum(rank, shift - 1), "right"),
                            lengths[length + 1]) - 1
            _, first, sequence, per, offset = steps[at].T
            many, within = np.divmod(rank - first, per)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + many), pa.array(offset + within * length)],
                names=[*_NAMES[:5], "sequence_id", "offset"])

    ranked = cut.join(offsets, ["length", "chunk"]).select(
        F.col(key).alias("key"), *_NAMES[1:5], (F.col("rank") + F.col("first")).alias("place"))
    return ranked.mapInArrow(
        run, "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("key", key)
