"""Corpus preparation in five stages; each stage's result is written as Parquet and read by the next.

Each function takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but
the last return the columns of docs. Rows with null or empty values pass or fall by the rules that
each operator states; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import compact_windows, line_crf, near_copies, packing, quality_rules
from turnloom.llm.common import read, remainder
from turnloom.session import shared_folder, ship

ORACLE_SQL = None  # no SQL for the learned classifier, the near-copy searches or the tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fences of their language and source."""
    return quality_rules.passing(spark, docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.7 or more. It is fitted on the labelled part of the
    original table, since the rules have taken most bad examples out of `docs`."""
    ship(spark)
    model = line_crf.fit(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
                         remainder("doc_id", 4) != 2)
    return line_crf.kept(docs, model)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, five-word shingles with a similarity of 0.8 or more, stays: the
    one with the least doc_id, then the least digest of its text."""
    ship(spark)
    return near_copies.one_of_each(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut from the text."""
    ship(spark)
    cut = compact_windows.without_passages(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", single),
    ("substring_dedup", passages),
    ("best_fit_packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(shared_folder(spark), "pipeline", f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
