"""Phrase collocations of each language by best-first branch and bound on the tree of phrases.

A phrase of 2 to 4 words scores by its weakest cut: floor(scale * a / (l + r)), with a, l and r the
occurrences of the phrase and of the cut's two parts. A phrase's prefix bounds all that grows from it:
with p a prefix of q, a(q) <= f(p), and the cut after the first word has r >= a(q), so
score(q) <= floor(scale * f(p) / (f(first word) + f(p))), a bound that only falls as phrases grow.

All single words have the same bound, so all frequent ones are grown. Then, for each language, the
frontier is expanded in the order of its bounds down to a cutoff, the score of the m-th best phrase of
two words: prefixes whose bound reaches the cutoff grow by a word (3, then 4 words). Every phrase that
scores the cutoff or more is then known. A phrase is dropped if a longer one with `share` % of its count
holds it; some phrase longer by one word at either end then does too, so phrases above the cutoff are
also grown to the left. A language is settled once `top` phrases at or above its cutoff survive, or
nothing is left below it; else m is raised fourfold and only the unsettled languages go on.

A scan counts phrases inside its task (numbers for words, sorted pairs), so what is shuffled is one row
for each distinct phrase of a batch of words. Which phrases a scan must count is told by bitmaps of fixed
size (`BITS`) over hashes: what they admit too much has right counts and does no harm. All counts meet in
Spark joins; the driver sees the bitmaps and the number of unsettled languages. Score arithmetic is on
decimals, as products may pass 64 bits.

Defined results: a null text is empty, a null language `und`; keys and other columns are not read, so
repeated rows count again; an empty table, or one without frequent phrases, gives no rows; ties go by
score, count, then the phrase's bytes. A text is split in parts of bounded size; a word is one value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import small
from turnloom.session import write_table

TOP, LEAST, SHARE, SCALE, LONGEST = 2_000, 30, 80, 2_000_000, 4
BITS = 1 << 22
FLUSH = 1 << 21  # words counted at once
_PART = 1 << 22  # bytes of a text split at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_BREAK = re.compile(rb"[ \t\n]")
_STOP = b"."  # stands between pieces; no word has one


@dataclass
class Wanted:
    """Which phrases to count, as bitmaps over hashes. Phrases of `sizes` words are counted if all their
    words (`words`) or neighbouring pairs (`pairs`) are frequent, and their prefix or suffix is listed."""

    sizes: tuple[int, ...]
    words: np.ndarray | None = None
    pairs: np.ndarray | None = None
    prefixes: dict[int, np.ndarray] | None = None
    suffixes: dict[int, np.ndarray] | None = None


class _Numbers(dict):
    """Numbers of a language's words; a new word takes the next number of all languages."""

    def __init__(self, words: list[bytes], langs: list[bytes], lang: bytes):
        self.words, self.langs, self.lang = words, langs, lang
        self[_STOP] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


class Counter:
    """Counts of a stream of texts; `flush` gives the phrases that start in what was read."""

    def __init__(self, wanted: Wanted):
        self.wanted = wanted
        self._begin()

    def _begin(self) -> None:
        self.words, self.langs, self.numbers, self.ids = [_STOP], [b""], {}, []

    def read(self, lang: bytes, text: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
        data, at = text.translate(_LOWER), 0
        while at < len(data):
            cut = _BREAK.search(data, at + _PART)
            end = cut.start() if cut else len(data)
            if lang not in self.numbers:
                self.numbers[lang] = _Numbers(self.words, self.langs, lang)
            part = data[at:end].replace(b"\n", b" " + _STOP + b" ").split()
            self.ids.extend(map(self.numbers[lang].__getitem__, part))
            at = end
            if len(self.ids) >= FLUSH:
                yield from self.flush(last=False)
        self.ids.append(0)

    def flush(self, last: bool = True) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """(keys, counts) of phrases; the last words stay, for phrases that go on with the next part."""
        more = LONGEST - 1
        kept = [] if last else [(self.langs[i], self.words[i]) for i in self.ids[-more:]]
        ids = np.array(self.ids + [0] * more if last else self.ids, np.int64)
        if len(ids) > more:
            yield from self._counts(ids, len(ids) - more)
        self._begin()
        for lang, word in kept:
            own = self.numbers.setdefault(lang, _Numbers(self.words, self.langs, lang))
            self.ids.append(own[word])

    def _counts(self, ids: np.ndarray, starts: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Of phrases that start at the first `starts` places; also each language's words, as an empty phrase."""
        want, longest = self.wanted, max(self.wanted.sizes)
        keys = [lang + b"\n" + word for lang, word in zip(self.langs, self.words)]
        if 1 in want.sizes:
            counts, totals = np.bincount(ids[:starts], minlength=len(keys)), dict.fromkeys(self.numbers, 0)
            found = np.flatnonzero(counts[1:]) + 1
            for i in found.tolist():
                totals[self.langs[i]] += int(counts[i])
            yield [keys[i] for i in found], counts[found]
            yield [lang + b"\n" for lang in totals], np.array(list(totals.values()), np.int64)
        if longest == 1:
            return
        own = marks = word_hashes(keys)
        here = (ids > 0) & _listed(want.words, own)[ids]  # where a phrase begins, one word shorter, that may be frequent
        code, parents = ids, []  # phrases by their place among the distinct ones; of these: shorter phrase, last word
        for size in range(2, longest + 1):
            here = here[:-1] & here[1:]
            counted = here
            if size > 2:
                counted = here & (_listed(want.prefixes.get(size), marks)[code[:-1]]
                                  | _listed(want.suffixes.get(size), marks)[code[1:]])
            if size == longest:
                here = counted
            at = np.flatnonzero(here)
            pairs, inverse = np.unique(code[at] << 32 | ids[at + size - 1], return_inverse=True)
            parents.append((pairs >> 32, pairs & 0xFFFFFFFF))
            marks = joined(marks[parents[-1][0]], own[parents[-1][1]])
            if size in want.sizes:
                counts = np.bincount(inverse[counted[at] & (at < starts)], minlength=len(pairs))
                found = np.flatnonzero(counts)
                yield self._texts(keys, parents, found), counts[found]
            if size == 2 and longest > 2:
                fine = _listed(want.pairs, marks)[inverse]
                at, inverse = at[fine], inverse[fine]
                here = np.zeros(len(here), bool)
                here[at] = True
            if not len(marks):
                return
            code = np.zeros(len(here), np.int64)
            code[at] = inverse

    def _texts(self, keys: list[bytes], parents: list, found: np.ndarray) -> list[bytes]:
        last = []
        for shorter, word in reversed(parents):
            last.append([self.words[i] for i in word[found].tolist()])
            found = shorter[found]
        return [b" ".join(t) for t in zip([keys[i] for i in found.tolist()], *reversed(last))]


def word_hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def joined(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word, from both hashes."""
    mixed = (phrase ^ (phrase >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    return mixed ^ (mixed >> np.uint64(32))


def _listed(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(hashes), bool)
    bits = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 == 1


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Hashes of (lang, phrase) as a bitmap; only words of 64 bits reach the driver, bits / 64 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(lang, phrase.split(" "))
                     for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            marks = np.zeros(len(split), np.uint64)
            for size in range(1, LONGEST + 1):
                rows = [i for i, (_, words) in enumerate(split) if len(words) >= size]
                own = word_hashes([f"{split[i][0]}\n{split[i][1][size - 1]}".encode() for i in rows])
                marks[rows] = own if size == 1 else joined(marks[rows], own)
            yield pa.record_batch([pa.array((marks & np.uint64(bits - 1)).astype(np.int64))], names=["b"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "b long").distinct().groupBy(
        (F.col("b") / 64).cast("long").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("v")).toPandas()
    words = np.zeros(bits // 64, "<i8")
    words[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return words.view(np.uint8)


def counts(texts: DataFrame, wanted: Wanted, least: int) -> DataFrame:
    """(lang, phrase, size, f) of the wanted phrases with `least` occurrences; size 0: a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(wanted)

        def rows(found):
            for keys, numbers in found:
                for at in range(0, len(keys), 1 << 16):
                    yield pa.record_batch([pa.array(keys[at:at + (1 << 16)], pa.binary()).cast(pa.string()),
                                           pa.array(numbers[at:at + (1 << 16)], pa.int64())], names=["key", "f"])

        for batch in small(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                yield from rows(counter.read(lang, text))
        yield from rows(counter.flush())

    phrase = F.substring_index("key", "\n", -1)
    sums = texts.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | F.endswith("key", F.lit("\n"))).select(
        F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"),
        phrase.alias("phrase"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("size"), "f")


def _ratio(scale: int, a: str, total: Column) -> Column:
    """floor(scale * a / total), exactly."""
    return F.call_function("div", F.col(a).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"),
                           total.cast("decimal(20,0)"))


def scored(found: DataFrame, known: DataFrame, scale: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score, bound): phrases whose parts are all known."""
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "size", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    each = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    each = each.withColumn("score", _ratio(scale, "a", F.col("l") + F.col("r")))
    weakest = each.groupBy("lang", "phrase", "size", "a").agg(
        F.count("*").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("w"),
        F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first"))
    return weakest.where(F.col("n") == F.col("size") - 1).select(
        "lang", "phrase", "size", "a", "w.l", "w.r", "w.score", _ratio(scale, "a", F.col("first") + F.col("a")).alias("bound"))


def _without(phrases: DataFrame, end: str) -> DataFrame:
    """The phrase without its last or first word."""
    cut = "^[^ ]+ " if end == "first" else " [^ ]+$"
    return phrases.select("lang", F.regexp_replace("phrase", cut, "").alias("phrase"), *[
        c for c in ("f",) if c in phrases.columns])


def mine(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP,
         least: int = LEAST, share: int = SHARE, scale: int = SCALE, first: int | None = None,
         bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language. `first` is the
    m of the first cutoff (twice `top` if not given)."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).select(
        F.col("lang").cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    words = write_table(spark, "words", counts(texts, Wanted((1,)), least))
    frequent = bitmap(words.where("size = 1"), bits)
    pairs = write_table(spark, "pairs", counts(texts, Wanted((2,), frequent), least).where("size = 2"))
    near = bitmap(pairs, bits)
    short = words.where("size = 1").unionByName(pairs)
    two = write_table(spark, "scored", scored(pairs, short, scale))

    m, live, settled = first or 2 * top, two.select("lang").distinct(), []
    while True:
        order = Window.partitionBy("lang").orderBy(F.desc("score"))
        place = two.join(live, "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= m)
        cutoff = write_table(spark, "cutoffs", place.groupBy("lang").agg(
            F.when(F.count("*") == m, F.min("score")).otherwise(F.lit(0)).alias("cutoff")))
        reach = lambda rows, by: rows.join(cutoff, "lang").where(F.col(by) >= F.col("cutoff"))
        three = write_table(spark, "threes", counts(texts, Wanted((3,), frequent, near, {
            3: bitmap(reach(two, "bound"), bits)}, {3: bitmap(reach(two, "score"), bits)}), least).where("size = 3"))
        scored3 = write_table(spark, "scored", scored(three, short, scale))
        open3 = reach(scored3, "bound")
        fours = write_table(spark, "fours", counts(texts, Wanted((3, 4), frequent, near, {
            3: bitmap(_without(open3, "first"), bits),
            4: bitmap(open3, bits)}, {4: bitmap(reach(scored3, "score"), bits)}), least).where("size > 0"))
        longer = three.unionByName(fours).distinct()
        scored4 = scored(fours.where("size = 4"), short.unionByName(longer.where("size = 3")), scale)
        holds = _without(longer, "first").unionByName(_without(longer, "last")).groupBy("lang", "phrase").agg(
            F.max("f").alias("held"))
        every = reach(two.unionByName(scored3).unionByName(scored4), "score")
        left = write_table(spark, "survivors", every.join(holds, ["lang", "phrase"], "left").where(
            F.col("held").isNull() | (F.col("held").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)))
        enough = write_table(spark, "settled", cutoff.join(left.groupBy("lang").count(), "lang", "left").select(
            "lang", ((F.col("cutoff") == 0) | (F.coalesce("count", F.lit(0)) >= top)).alias("done")))
        settled.append(left.join(enough.where("done"), "lang"))
        live = enough.where("NOT done").select("lang")
        if live.isEmpty():
            break
        m *= 4
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.where("size = 0").select("lang", F.col("f").alias("n"))
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).join(
        totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
