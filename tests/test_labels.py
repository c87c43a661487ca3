"""Label, code, id and time expressions."""

import pytest
from pyspark.sql import functions as F

from turnloom.functions import labels as L


def values(spark, items, make):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_every_label_has_one_group():
    labels = [x for members in L.EXTENDED_GROUPS.values() for x in members]
    assert len(labels) == len(set(labels))
    assert set(L.members(L.CORE_GROUPS)) <= set(labels)
    assert set(L.GROUP_ABBREVIATIONS) == {*L.EXTENDED_GROUPS, L.OTHER}


def test_groups_and_defaults(spark):
    items = ["Hedge", "Quotation", "made up", None]
    assert values(spark, items, L.extended_group) == ["hedge", "elaboration", "other", "other"]
    assert values(spark, items, L.core_group) == ["hedge", None, None, None]
    assert values(spark, items, lambda c: L.core_group(c, "unmapped"))[1:] == ["unmapped"] * 3


def test_abbreviations(spark):
    assert values(spark, ["statements_medium", "hedge", "other_long", "new_short"],
                  lambda c: L.abbreviate(c, "groups")) == ["ST_M", "HG", "OT_L", "new_S"]
    assert values(spark, ["Wh-Question_short", "Yes-answers", "Statement-opinion", "Acknowledge-Backchannel",
                          "Conventional-closing", "Collaborative-Completion"],
                  lambda c: L.abbreviate(c, "raw")) == [
        "Wh-Q_S", "Yes-A", "ST-opinion", "Ack-Backchannel", "Conv-closing", "Collab-Completion"]
    assert values(spark, ["a_short", "a_b", "x_long"], L.strip_bucket) == ["a", "a_b", "x"]


@pytest.mark.parametrize("group,length,bucket", [
    ("statements", 2, "short"), ("statements", 3, "medium"), ("statements", 8, "medium"), ("statements", 9, "long"),
    ("hedge", 1, "short"), ("hedge", 2, "medium"), ("hedge", 3, "medium"), ("hedge", 4, "long"),
])
def test_run_length_buckets(spark, group, length, bucket):
    row = spark.range(1).select(L.bucket_label(F.lit(group), F.lit(length), "groups").alias("b")).first()
    assert row.b == f"{group}_{bucket}"


def test_raw_labels_use_their_groups_thresholds(spark):
    row = spark.range(1).select(L.bucket_label(F.lit("Statement-opinion"), F.lit(5), "raw").alias("b")).first()
    assert row.b == "Statement-opinion_medium"


def test_codes(spark):
    items = ["IAI, VLD", " BCS ,, nan,\tFSU\t", "", None, "None"]
    assert values(spark, items, L.parse_codes) == [
        ["IAI", "VLD"], ["BCS", "FSU"], ["NA"], ["NA"], ["NA"]]
    assert values(spark, ["VLD", "NA", None], L.describe_code) == ["Validating", "NA", "NA"]


def test_ids_in_file_names(spark):
    items = ["session3_with_patient.csv", "T2_with_client_01.csv", "no_marker_here.csv"]
    assert values(spark, items, L.therapist_before_marker) == ["3", "2", "unknown"]
    items = ["randomT1_session.csv", "sessionT12_abc.csv", "sessiont7.csv", "x_T9.csv"]
    assert values(spark, items, L.therapist_in_prefix) == ["1", "12", "7", "unknown"]
    items = ["randomAC01_session.csv", "ac12_data.csv", "AC1.csv", "none.csv"]
    assert values(spark, items, L.patient_in_name) == ["01", "12", None, None]


def test_speakers(spark):
    assert values(spark, [" Therapist ", "THERAPIST", "S1", "Patient", None], L.normalise_speaker) == [
        "therapist", "therapist", "patient", "patient", "patient"]


def test_clock_text(spark):
    assert values(spark, ["0:05", "12:34", "1:02:03", "7.5", "soon", "a:b", None], L.clock_seconds) == [
        5.0, 754.0, 3723.0, 7.5, None, None, None]
