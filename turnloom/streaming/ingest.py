"""Incremental ingest: a stream of file arrivals, each batch of which is admitted file by file.

The checkpoint remembers which files arrived, so a rerun takes only new ones and a failed run continues
where it stopped. A batch is the files' paths; their headers are checked, good files are read by name,
and the others go to a table of refusals, so no file stops those that come with it or after it. A batch
writes its own folder and overwrites it when it runs again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from turnloom.session import write_table
from turnloom.sources import readers


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Paths of new files below a folder, whatever their names; contents are not read."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .options(recursiveFileLookup="true", maxFilesPerTrigger=str(files_per_batch)).load(path)
        .select("path")
    )


def process_new(files: DataFrame, schema: StructType, handle: Callable[[DataFrame, int], None], refused: str,
                checkpoint: str, required: Sequence[str] = (), multiline: bool = True) -> StreamingQuery:
    """Run a batch function (annotate, collapse, write) on the rows of what is new, then stop. Each
    batch's refused files go to `refused`, a Parquet folder of (path, source_file, reason)."""

    def batch(paths: DataFrame, number: int) -> None:
        spark = paths.sparkSession
        new = [r.path for r in paths.collect()]  # as many as a batch takes
        if not new:
            return
        found = write_table(spark, "arrived", readers.admitted(
            spark, new, required, [f.name for f in schema.fields], multiline))
        found.filter("reason IS NOT NULL").select("path", "source_file", "reason").write.mode("overwrite").parquet(
            os.path.join(refused, f"batch={number}"))
        handle(readers.read_admitted(spark, found, schema, multiline), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new(files: DataFrame, schema: StructType, out: str, refused: str, checkpoint: str,
               required: Sequence[str] = (), multiline: bool = True) -> StreamingQuery:
    """Add the rows of what is new to a Parquet folder, then stop."""

    def handle(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return process_new(files, schema, handle, refused, checkpoint, required, multiline)
