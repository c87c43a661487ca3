"""Transcript files as DataFrames, and checks on what was read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnloom.schemas import OLD_WORD

SEPARATORS = {"csv": ",", "tsv": "\t"}
CORRUPT = "_corrupt_record"
MAX_FILE_BYTES = 1 << 30
WHOLE_BYTES = 1 << 26  # a larger file's rows are numbered by block, never sorted in one task
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _options(extension: str, multiline: bool) -> dict[str, str]:
    return {
        "header": "true", "sep": SEPARATORS[extension], "multiLine": str(multiline).lower(),
        "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreCorruptFiles": "true",
    }


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Inside, some tasks for each core list the folders of a read. Spark starts a task for each folder or path, up
    to thousands, and such a task takes longer to start than a folder takes to list."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(min(int(before or 10_000), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(LISTING)
        else:
            spark.conf.set(LISTING, before)


def listed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, source_file, extension and size of every file below `path`; contents are not read."""
    with few_listings(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("source_file"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.col("length").alias("size"))


def first_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path and header of each file, from the block a file starts with."""
    with few_listings(spark):
        texts = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(paths)
    lines = texts.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")
    return lines.filter("_block = 0").groupBy("path").agg(F.min_by("value", "_row").alias("header"))


def _names(header: Column, extension: Column) -> Column:
    cells = F.when(extension == "tsv", F.split(header, "\t")).otherwise(F.split(header, ","))
    return F.transform(cells, lambda c: F.regexp_replace(F.trim(c), "[\"\ufeff\r]", ""))


def admitted(spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = (),
             known: Sequence[str] | None = None, multiline: bool = True, max_file_bytes: int = MAX_FILE_BYTES,
             names: dict[str, str] | None = None) -> DataFrame:
    """One row per file below `path`: path, source_file, extension, size, `columns` and, for files that
    are not to be read, the `reason`.

    A name or folder that starts with `=` marks a broken export. Files without a byte do not appear. A file must have a known extension, a
    header that names no column twice, all `required` columns and, if `known` is given, at least one of
    those. With `multiline` a file is one task's work and must not be larger than `max_file_bytes`.
    `names` maps the header's names to the columns' names.
    """
    files = listed(spark, path)
    marked = F.exists(F.split("path", "/"), lambda part: part.startswith("="))
    found = files.join(first_lines(spark, path), "path", "left").withColumn(
        "columns", _names(F.col("header"), F.col("extension")))
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        found = found.withColumn("columns", F.transform("columns", lambda c: F.coalesce(table[c], c)))
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), F.col("columns"))
    reason = (
        F.when(marked, "marked as broken")
        .when(~F.col("extension").isin(*SEPARATORS), "unknown extension")
        .when(F.col("header").isNull(), "unreadable")
        .when(F.size("columns") != F.size(F.array_distinct("columns")), "column named twice")
        .when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    )
    if known is not None:
        reason = reason.when(~F.arrays_overlap("columns", F.array(*[F.lit(c) for c in known])), "foreign header")
    if multiline:
        reason = reason.when(F.col("size") > max_file_bytes, "too large for one task")
    return found.select("path", "source_file", "extension", "size", "columns", reason.alias("reason"))


def _scan(spark: SparkSession, paths: Sequence[str], extension: str, names: Sequence[str], schema: StructType,
          multiline: bool) -> DataFrame:
    """Files of one header."""
    types = {f.name: f.dataType for f in schema.fields}
    layout = StructType([StructField(n, types.get(n, StringType())) for n in names] + [StructField(CORRUPT, StringType())])
    with few_listings(spark):
        read = spark.read.schema(layout).options(**_options(extension, multiline)).csv(paths)
    rows = read.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    return rows.select(
        "_path", "source_file", "_block", "_row",
        *[(F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
          for f in schema.fields],
        CORRUPT,
    )


def read_admitted(spark: SparkSession, files: DataFrame, schema: StructType, multiline: bool = True) -> DataFrame:
    """Rows of the files that `admitted` found good: one scan of its own files per header, two for files of more
    than `WHOLE_BYTES`.

    The driver holds the file list, as it does for any scan. Rows get `source_file`, dense `pos` in file
    order, and `_corrupt_record` where a line did not parse; columns a file lacks are null.
    """
    good = files.filter("reason IS NULL").groupBy("extension", "columns", (F.col("size") > WHOLE_BYTES).alias("large")).agg(
        F.sort_array(F.collect_list("path")).alias("paths"))
    parts: dict[bool, list[DataFrame]] = {}
    for r in good.orderBy("extension", "columns").toLocalIterator():
        parts.setdefault(r.large, []).append(_scan(spark, r.paths, r.extension, r.columns, schema, multiline))
    if not parts:
        empty = StructType([StructField("source_file", StringType()), *schema.fields])
        return spark.createDataFrame([], empty).withColumns(
            {CORRUPT: F.lit(None).cast("string"), "pos": F.lit(None).cast("long")})
    numbered = {False: number_whole_files, True: number_file_rows}
    return reduce(DataFrame.unionByName, [numbered[large](reduce(DataFrame.unionByName, scans)) for large, scans in parts.items()])


def read_transcripts(spark: SparkSession, path: str | Sequence[str], schema: StructType, required: Sequence[str] = (),
                     multiline: bool = True, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """All CSV and TSV transcripts below a folder, columns found by name; what `admitted` refuses is left
    out. `multiline=True` accepts line breaks inside quotes and keeps a file in one task; without it
    large files are split."""
    files = admitted(spark, path, required, [f.name for f in schema.fields], multiline, max_file_bytes)
    return read_admitted(spark, files, schema, multiline)


def number_whole_files(rows: DataFrame) -> DataFrame:
    """Dense positions per file (`_path`), whose rows are read once and sorted together."""
    order = Window.partitionBy("_path").orderBy("_block", "_row")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("_path", "_block", "_row")


def number_file_rows(rows: DataFrame) -> DataFrame:
    """Dense positions per file (`_path`) from block offset and row order inside a block."""
    counts = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_path", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_path", "_block").orderBy("_row")
    return (
        rows.join(offsets, ["_path", "_block"])
        .withColumn("pos", F.row_number().over(local) - 1 + F.col("_before"))
        .drop("_path", "_block", "_row", "_before")
    )


def read_old_words(spark: SparkSession, path: str, schema: StructType, multiline: bool = False,
                   names: dict[str, str] = OLD_WORD) -> DataFrame:
    """Word files in the older layout: `names` maps the names in their headers to those in `schema`.
    Columns are found by name, and files that lack one of them are left out."""
    files = admitted(spark, path, list(names.values()), None, multiline, names=names)
    return read_admitted(spark, files, schema, multiline)


def file_key(name: Column) -> Column:
    """The first five `_` parts of a file name identify an interview."""
    return F.substring_index(name, "_", 5)


def latest_per_key(files: DataFrame, name: str = "source_file") -> DataFrame:
    """One file per key; a later name replaces an earlier one."""
    return files.groupBy(file_key(F.col(name)).alias("file_key")).agg(F.max(name).alias(name))


def not_processed(files: DataFrame, done: DataFrame, name: str = "source_file") -> DataFrame:
    """Files whose key does not occur among the finished ones."""
    keys = done.select(file_key(F.col(name)).alias("file_key")).distinct()
    return latest_per_key(files, name).join(keys, "file_key", "left_anti")


def require_groups(df: DataFrame, key: str, at_least: int = 2) -> DataFrame:
    """The same rows, or none of them when there are fewer than `at_least` groups."""
    enough = df.select(key).distinct().limit(at_least).count() >= at_least
    return df if enough else df.limit(0)
