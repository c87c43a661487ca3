"""What the text operators share: reading a table, key and text under fixed names, small batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 256  # rows an operator holds as Python objects at once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", binary: bool = False,
          more: list[str] | None = None) -> DataFrame:
    """`key` and `text`, and `more`, alone, so other columns of the input never clash; a null text is
    empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        (body.cast("binary") if binary else body).alias("text"), *(more or []),
    )


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`: the fold a row belongs to."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
