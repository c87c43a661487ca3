"""The registered query of each operator, over its whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import (
    ann, bpe, chat, collocations, compact_windows, hard_negatives, line_crf, packing, quality_rules, simhash, sql,
    suffix_dedup, token_counts, toxicity,
)
from turnloom.llm.common import read, remainder
from turnloom.session import ship, write_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    QUERIES[query.__name__] = run
    return query


@registered
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = toxicity.fit(spark, docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_segments", "best", "evidence")


@registered
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    measures = write_table(spark, "measures", quality_rules.measured(docs).select("doc_id", "_m"))
    limits = write_table(spark, "fences", quality_rules.fences(quality_rules.sketch(measures)))
    return quality_rules.judged(measures, limits).select(
        "doc_id", *[f"_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed")], F.col("_kept").alias("kept"))


ORACLES["op2_quality_rules"] = sql.quality_rules_sql()


@registered
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


PLANTED = "\\### Assistant: </turn> ok"


@registered
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    return chat.digests(chat.read_back(chat.windows(turns.unionByName(more))))


ORACLES["op4_chat_windows"] = sql.chat_windows_sql(PLANTED)


@registered
def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage that an earlier document has; `source_id` is the earliest it was matched to."""
    found = compact_windows.find_passages(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("passages").alias("p")).select(
        "doc_id", F.col("p.sources")[0].alias("source_id"), "p.start_word", "p.end_word",
        (F.col("p.end_word") - F.col("p.start_word")).alias("n_words"), "p.sources")


@registered
def op6_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform("spans", lambda s: s.end - s.start)
    return suffix_dedup.remove_repeats(spark, read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_suffix_runs"] = sql.suffix_runs_sql()


@registered
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(spark, read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@registered
def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@registered
def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = line_crf.fit(spark, docs, read(spark, sf_dir, "labels"), ~held_out)
    return line_crf.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "good_lines")


@registered
def op11_finite_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@registered
def op12_best_first_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spark, read(spark, sf_dir, "documents"))


ORACLES["op12_best_first_collocations"] = sql.COLLOCATIONS


@registered
def op13_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    mislabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", mislabelled)
    return hard_negatives.mine(spark, vectors, F.col("vec_id") % 100 == 0)


ORACLES["op13_packed_negatives"] = sql.PACKED_NEGATIVES
