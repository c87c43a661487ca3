"""Question and response patterns along a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators.ordered import Ordering, carry, nearby


def label_patterns(hub: DataFrame, order: Ordering) -> DataFrame:
    """Mark questions directly followed by statements or hedges, and that run of responses.

    `pattern_id` counts patterns from 0 in each transcript and is null outside them.
    """
    group = F.coalesce(L.core_group(F.col("proc_da")), F.lit(""))
    rows = hub.withColumns({
        "_question": group.isin(*L.QUESTION_GROUPS),
        "_response": group.isin(*L.RESPONSE_GROUPS),
    })
    rows = nearby(
        rows, order, {"_next": lambda w: F.lead("_response").over(w)}, after=1, keep_segment=True
    ).withColumn("is_pattern_question", F.col("_question") & F.coalesce(F.col("_next"), F.lit(False)))
    rows = carry(
        rows,
        order,
        latest={"_anchored": F.when(~F.col("_response"), F.col("is_pattern_question"))},
        running={"_patterns": F.col("is_pattern_question").cast("long")},
    ).withColumn("is_pattern_response", F.col("_response") & F.coalesce(F.col("_anchored"), F.lit(False)))
    inside = F.col("is_pattern_question") | F.col("is_pattern_response")
    return rows.withColumn("pattern_id", F.when(inside, F.col("_patterns") - 1)).drop(
        "_question", "_response", "_next", "_anchored", "_patterns")


def pattern_table(labelled: DataFrame) -> DataFrame:
    """Per pattern: run length, majority response speaker (ties to the smaller name), and the
    question's speaker and importance."""
    keys = ["source_file", "pattern_id"]
    by_speaker = (
        labelled.filter("is_pattern_response").groupBy(*keys, "speaker")
        .agg(F.count("*").alias("_n"))
    )
    responses = by_speaker.groupBy(*keys).agg(
        F.sum("_n").alias("run_length"),
        F.min_by("speaker", F.struct(-F.col("_n"), F.col("speaker"))).alias("response_speaker"),
    )
    questions = labelled.filter("is_pattern_question").select(
        *keys, F.col("speaker").alias("question_speaker"),
        "patient_important", "therapist_important")
    return responses.join(questions, keys, "left")
