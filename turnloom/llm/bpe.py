"""Byte-level BPE: text to token ids and back, through tiktoken and a local rank file.

`encode` and `decode` map rows where they lie; nothing is shuffled. A text longer than `limit`
characters is encoded in pieces cut where the split pattern must end a match anyway, so that the ids
are those of the whole text. Ids travel as little-endian unsigned 32-bit integers in one binary value.

Defined results: a null text is the empty text (no ids, empty digest); a null key stays; repeated
rows give repeated rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from turnloom.llm.common import keyed, small

LIMIT = 1 << 16
# A match holds white space only at its start, letters and digits never together, and a run of white
# space before a word leaves its last character to the word. So a match ends at each of these places.
_SAFE = re.compile(
    r"(?<=\S)(?=[ \t\n\r\x0b\x0c])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
)


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One encoder per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = LIMIT) -> Iterator[str]:
    """The text in pieces of about `limit` characters, cut at safe boundaries; without one in
    reach a piece grows until the next."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def token_ids(encoder, text: str, limit: int = LIMIT) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    return b"".join(
        np.asarray(encoder.encode_ordinary(piece), "<u4").tobytes() for piece in pieces(text, limit)
    )


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text",
           limit: int = LIMIT) -> DataFrame:
    """(key, ids): the token ids of every whole text, special tokens read as plain text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(rank_file, pattern)
        for batch in small(batches):
            ids = [token_ids(encoder, t, limit) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(ids, pa.binary())], names=["key", "ids"])

    return keyed(docs, key, text).mapInArrow(run, "key long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the raw bytes of `ids`; bytes need not be valid UTF-8. Null ids give null."""
    fields = [f for f in encoded.columns if f != "decoded"]
    source = encoded.select(*[F.col(f"`{f}`") for f in fields])
    schema = StructType([*source.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(rank_file, pattern)
        for batch in small(batches):
            texts = [None if ids is None else encoder.decode_bytes(np.frombuffer(ids, "<u4").tolist())
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], names=[*fields, "decoded"])

    return source.mapInArrow(run, schema)
