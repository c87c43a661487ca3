"""Tables that several analyses read, written once per session and state of the data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import blocks as B
from turnloom.operators import ngrams as N
from turnloom.operators import words as W
from turnloom.operators.ordered import SEGMENT_ROWS, Ordering, number_by_time
from turnloom.plans import bridge
from turnloom.session import release, state, write_table

SIZES = (2, 3, 4, 5)


class Tables:
    """Lazily written intermediates over one data folder.

    The longest transcript is measured first. Only when all transcripts fit one segment do
    the ordered primitives use plain per-transcript windows.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, segment_rows: int = SEGMENT_ROWS):
        self.spark, self.sf_dir, self._limit = spark, sf_dir, segment_rows
        self.state = inputs(spark, sf_dir)
        self._written: dict[str, DataFrame] = {}
        self._order: Ordering | None = None
        self._word_order: Ordering | None = None

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._written:
            self._written[name] = write_table(self.spark, name, build())
        return self._written[name]

    @property
    def order(self) -> Ordering:
        if self._order is None:
            longest = (
                bridge.read(self.spark, self.sf_dir, "events")
                .groupBy("user_id").count().agg(F.max("count")).first()[0]
            )
            fits = (longest or 0) <= self._limit
            self._order = Ordering(segment_rows=None if fits else self._limit)
        return self._order

    def measured(self, rows: DataFrame, pos: str) -> Ordering:
        """Plain windows if the longest sequence of `rows` fits one segment."""
        longest = rows.groupBy("source_file").count().agg(F.max("count")).first()[0]
        fits = (longest or 0) <= self._limit
        return Ordering(pos=pos, segment_rows=None if fits else self._limit)

    def words(self) -> DataFrame:
        """Words of the cleaned conversation turns."""
        def build():
            turns = W.clean_turns(bridge.turns(self.spark, self.sf_dir))
            return W.turn_words(turns, self.measured(turns, "turn"))

        return self.once("words", build)

    def word_order(self) -> Ordering:
        if self._word_order is None:
            self._word_order = self.measured(self.words(), "pos")
        return self._word_order

    def _numbered(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows in transcript order. Segmented numbering is written, since every `carry` that
        follows reads its input twice."""
        def build():
            return number_by_time(
                rows, "source_file", "ts", ["event_id"], segment_rows=self.order.segment_rows)

        return build() if self.order.segment_rows is None else self.once(name, build)

    def numbered_events(self) -> DataFrame:
        """All rows in transcript order, inside labels included."""
        return self._numbered("numbered_events", bridge.event_rows(self.spark, self.sf_dir))

    def dialogue_acts(self) -> DataFrame:
        rows = bridge.event_rows(self.spark, self.sf_dir).filter(F.col("proc_da") != L.INSIDE_LABEL)
        return self._numbered("dialogue_acts", rows).withColumn(
            "da_group", L.extended_group(F.col("proc_da"))).drop("ts", "event_id")

    def hub(self) -> DataFrame:
        """Dialogue-act rows with island bounds."""
        return self.once("hub", lambda: B.index_islands(self.dialogue_acts(), self.order))

    def block_codes(self, target: str) -> DataFrame:
        return self.once(f"{target}_block_codes", lambda: B.block_codes(self.hub(), target))

    def classes(self, granularity: str = "groups") -> DataFrame:
        """Compressed rows of the four sequence classes the bag of words compares."""
        return B.compressed_classes(
            self.hub(), ("patient", "therapist", "neither", "transcript"), granularity)

    def ngram_counts(self) -> DataFrame:
        """level, group, n, ngram, cnt for the five comparison levels."""
        return self.once("ngram_counts", self._ngram_counts)

    def _ngram_counts(self) -> DataFrame:
        found = N.ngrams(self.classes(), self.order.keyed("source_file", "cls"), SIZES)
        cls = F.col("cls")
        pooled = N.count_ngrams(
            found.select(F.inline(plain_groups()), "n", "ngram"), "level", "group")
        per_block = N.count_ngrams(
            found.filter(cls.isin("patient", "therapist")), "source_file", "cls", "seq"
        )
        parts = [pooled]
        for target in B.TARGETS:
            coded = N.spread_over_codes(
                per_block.filter(cls == target),
                self.block_codes(target).filter(F.col("code") != "NA"),
            )
            parts.append(
                coded.withColumns({
                    "level": F.lit(f"{target}_codes"),
                    "group": F.concat(F.lit(f"{target}_"), F.col("code")),
                }).groupBy("level", "group", "n", "ngram").agg(F.sum("cnt").alias("cnt"))
            )
        return reduce(DataFrame.unionByName, parts)


def plain_groups() -> Column:
    """(level, group) entries of a sequence row by its class, code groups aside."""
    cls, name = F.col("cls"), F.col("source_file")

    def entry(level: str, group: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), group.alias("group"))

    baseline = F.lit("non_important")
    return (
        F.when(cls == "transcript", F.array(
            entry("transcripts", name),
            entry("therapists", F.concat(F.lit("therapist_"), L.therapist_before_marker(name))),
        ))
        .when(cls == "neither", F.array(
            entry("importance", baseline),
            entry("patient_codes", baseline),
            entry("therapist_codes", baseline),
        ))
        .otherwise(F.array(entry("importance", F.concat(cls, F.lit("_important")))))
    )


_TABLES: dict[tuple[str, str], Tables] = {}


def inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """State of the files that the shared tables are made of."""
    return state(spark, [bridge.path(sf_dir, name) for name in bridge.TABLES])


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The shared tables of a folder, made anew once its input has changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES or _TABLES[key].state != inputs(spark, sf_dir):
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def clear(spark: SparkSession) -> None:
    """Delete all tables this application wrote; later queries write theirs again."""
    for key in [k for k in _TABLES if k[0] == spark.sparkContext.applicationId]:
        del _TABLES[key]
    release(spark)
