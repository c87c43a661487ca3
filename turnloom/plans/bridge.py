"""Views that give the driver's generic tables the transcript layouts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ("events", "conversations", "labels")


def path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(path(sf_dir, table))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as unnumbered dialogue-act rows, one transcript per user."""
    k = F.col("k")
    value = F.col("value")
    user = F.col("user_id")
    return (
        read(spark, sf_dir, "events")
        .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        .select(
            F.concat(
                F.lit("sessionT"), (user % 5).cast("string"), F.lit("_with_AC"),
                F.lpad((user % 20).cast("string"), 2, "0"), F.lit("_"), user.cast("string"),
                F.lit(".csv"),
            ).alias("source_file"),
            "event_id",
            "ts",
            F.date_format("ts", "H:mm:ss").alias("timestamp"),
            F.when(k % 3 == 0, "Therapist").otherwise("Patient").alias("speaker"),
            F.concat_ws(" ", "event_type", k.cast("string")).alias("spoken_text"),
            F.when(k % 10 == 0, "Acknowledge-Backchannel")
            .when(k % 17 == 0, "I-")
            .when(k % 23 == 0, "Quotation")
            .when(F.col("event_type") == "view", "Statement-non-opinion")
            .when(F.col("event_type") == "click", "Statement-opinion")
            .when(F.col("event_type") == "error", "Hedge")
            .when(F.col("event_type") == "signup", "Wh-Question")
            .otherwise("Yes-answers").alias("proc_da"),
            F.when(value > 60, 1).otherwise(0).alias("patient_important"),
            F.when((value < 12) | (value > 90), 1).otherwise(0).alias("therapist_important"),
            F.when(value <= 60, None).when(k % 7 == 0, "IAI, VLD").when(k % 2 == 0, "BCS")
            .when(k % 5 == 0, "FTA").otherwise("FSU").alias("patient_code"),
            F.when((value >= 12) & (value <= 90), None).when(k % 7 == 0, "ERT, IDR")
            .when(k % 2 == 0, "STK").when(k % 5 == 0, "").otherwise("HPM")
            .alias("therapist_code"),
        )
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` in the turn layout."""
    role = F.col("role")
    return read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("source_file"),
        F.col("turn").cast("long").alias("turn"),
        F.when(role == "assistant", "Therapist").when(role == "user", "Patient")
        .otherwise("system").alias("speaker"),
        F.col("text").alias("spoken_text"),
    )
