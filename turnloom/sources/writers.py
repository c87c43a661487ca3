"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_delimited(df: DataFrame, path: str, sep: str = ",", partition_by: Sequence[str] = (),
                    extension: str = "csv") -> None:
    writer = df.write.mode("overwrite").options(header=True, escape='"', sep=sep, extension=extension)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def matrix(pairs: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Long pairs as a wide matrix. The column list is given, so nothing is collected."""
    return pairs.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def mirrored(pairs: DataFrame, value: str, diagonal: float | None = None) -> DataFrame:
    """Pairs a < b as a full symmetric relation, with the diagonal when given."""
    both = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))]
    out = pairs.select(F.inline(F.array(*both)), value)
    if diagonal is None:
        return out
    names = out.select("a").distinct()
    return out.unionByName(names.select("a", F.col("a").alias("b"), F.lit(diagonal).alias(value)))


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A summary an earlier run wrote."""
    return spark.read.schema(schema).json(path)
