"""Declared layouts of transcript files."""

from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TURN = _struct(
    speaker=StringType(), timestamp=StringType(), patient_important=IntegerType(),
    patient_code=StringType(), therapist_important=IntegerType(), therapist_code=StringType(),
    spoken_text=StringType(),
)

ANNOTATION = _struct(
    Pred_DA=StringType(), Raw_Score=DoubleType(), Proc_DA=StringType(), Score=DoubleType(),
    Words_Prediction=StringType(), DA_number=LongType(),
)

WORD = StructType(TURN.fields + ANNOTATION.fields)

# Older word layout: the names in its header, and the same columns' names in WORD.
OLD_WORD = {
    "speaker": "speaker", "spoken_text": "spoken_text", "label": "Pred_DA", "confidence": "Raw_Score",
    "label class": "Proc_DA", "DA number": "DA_number",
}
