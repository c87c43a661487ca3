"""Search for repeats across documents: anchors, the few that recur, and a verdict on each.

Documents are dealt into runs by a hash of their key. Every method marks anchors in its texts, places
that equal passages share, each with a 64-bit hash. The steps are

1. each run sends the hashes of its anchors, each once, to buckets by hash;
2. each bucket sends back to a run those that another run has too;
3. each run sends what the method needs of the anchors that recur, there or inside the run;
4. each bucket merges what the runs sent and sends a verdict on every entry back;
5. each run turns the verdicts into results for its documents.

Texts are shuffled once, by run, and that exchange serves steps 1, 3 and 5; only hashes, contexts of
recurring anchors and verdicts move besides. Exact copies of a text take no part: a copy's fate
follows from the first copy's, so a group of any number of copies is one document. Anchors that
several documents of a run share with equal context are one entry, so what a bucket receives of a
frequent passage grows with the number of runs, not of documents. Every step depends only on the set
of rows in its group, so a lost executor's work is redone with the same result.

Run size grows with the square root of the input up to a limit, which keeps the number of (run,
bucket) messages in proportion to the data.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import keyed
from turnloom.session import write_table

RUN_BYTES = (1 << 18, 1 << 28)  # least and most
_LOW = np.uint64((1 << 48) - 1)


@dataclass
class Run:
    """Documents of one run in the order of key and text; `copy` marks those that take no part, and
    `first` has the key of the text's first copy. `held` is for what a method wants to keep."""

    keys: np.ndarray
    texts: list[bytes]
    copy: np.ndarray
    nulls: np.ndarray
    first: np.ndarray
    rest: pa.ChunkedArray | None = None
    held: dict = field(default_factory=dict)


@dataclass
class Anchors:
    """Hash, document and place of each anchor of a run."""

    hashes: np.ndarray
    docs: np.ndarray
    places: np.ndarray


class Method(Protocol):
    def anchors(self, run: Run) -> Anchors: ...

    def entries(self, run: Run, found: Anchors, buckets: np.ndarray) -> Entries: ...

    def merge(self, parts: list[bytes]) -> list[bytes]: ...

    def results(self, run: Run, found: Anchors, entries: Entries, verdicts: dict[int, bytes]) -> pa.Table: ...


@dataclass
class Entries:
    """What a run sends: one message per bucket, and for each anchor its entry in that message."""

    messages: dict[int, bytes]
    buckets: np.ndarray  # per anchor
    entry: np.ndarray
    first: np.ndarray  # per anchor: the least key of the entry's documents


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed message."""
    sizes = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def unpack(message: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(message, max_output_size=1 << 31)
    at, out = 8 * len(types), []
    for size, kind in zip(np.frombuffer(raw[:at], "<i8").tolist(), types):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits; the low 48 bits tell hashes of a bucket apart."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _six(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


_COPY = np.dtype([("key", "<i8"), ("size", "<i8"), ("first", "<i8"), ("digest", "V32")])


def _run(table: pa.Table, control: pa.Table) -> tuple[int, Run, dict[str, dict[int, bytes]]]:
    nulls = table["key"].is_null().to_numpy()
    keys = table["key"].fill_null(np.iinfo(np.int64).max).to_numpy()
    texts = table["text"].to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
    keys, nulls, texts = keys[order], nulls[order], [texts[i] for i in order]
    said: dict[str, dict[int, bytes]] = {"copy": {}, "again": {}, "verdict": {}}
    for kind, bucket, data in zip(*(control[c].to_pylist() for c in ("kind", "bucket", "data"))):
        said[kind][bucket] = data
    known = np.frombuffer(said["copy"].get(0, b""), _COPY)
    copies = {(k, d): first for k, d, first in known[["key", "digest", "first"]].tolist()}
    sizes = set(zip(known["key"].tolist(), known["size"].tolist()))
    first = np.array([copies.get((k, hashlib.sha256(t).digest()), k) if (k, len(t)) in sizes else k
                      for k, t in zip(keys.tolist(), texts)], np.int64)
    rest = table["rest"].take(pa.array(order, pa.int64())) if "rest" in table.column_names else None
    return table["run"][0].as_py(), Run(keys, texts, (first != keys) | nulls, nulls, first, rest), said


def _recurring(found: Anchors, buckets: int, again: dict[int, bytes]) -> tuple[Anchors, np.ndarray]:
    """The anchors whose hash another run has, or another document of this run."""
    bucket = bucket_of(found.hashes, buckets)
    code = (bucket << np.uint64(48)) | (found.hashes & _LOW)
    told = [_eight(d) | (np.uint64(b) << np.uint64(48)) for b, d in again.items()]
    keep = np.isin(code, np.concatenate(told)) if told else np.zeros(len(code), bool)
    order = np.argsort(code, kind="stable")
    a, d = code[order], found.docs[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    if len(starts):
        shared = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        keep[order] |= np.repeat(shared, np.diff(np.append(starts, len(a))))
    return Anchors(found.hashes[keep], found.docs[keep], found.places[keep]), bucket[keep].astype(np.int64)


_MESSAGES = "run int, kind string, bucket int, data binary"


def _table(run, kind, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "run": pa.array([run] * len(rows) if not isinstance(run, list) else run, pa.int32()),
        "kind": pa.array([kind] * len(rows), pa.string()),
        "bucket": pa.array([int(b) for b, _ in rows], pa.int32()),
        "data": pa.array([d for _, d in rows], pa.binary()),
    })


def search(spark: SparkSession, docs: DataFrame, method: Method, schema: str, key: str = "doc_id",
           text: str = "text", run_bytes: tuple[int, int] = RUN_BYTES, carry: list[str] | None = None) -> DataFrame:
    """`method.results` over all documents, one call per run, with columns `schema`, and with `rest`,
    a struct of the columns `carry` of each row, if any are named.

    Rows with a null key take no part but appear in `results`; of rows with equal key and text all do.
    """
    more = []
    if carry:
        rest = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")
        schema += f", rest {docs.select(rest).schema['rest'].dataType.simpleString()}"
        docs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), rest)
        more = ["rest"]
    rows = keyed(docs, key, text, True, more).withColumn("n", F.octet_length("text"))
    marks = write_table(spark, "copies", rows.select("key", "n", F.sha2("text", 256).alias("digest")))
    total = marks.agg(F.sum("n")).first()[0] or 0
    least, most = run_bytes
    runs = min(65_535, max(1, math.ceil(total / min(most, max(least, 200 * math.sqrt(total))))))
    own = F.pmod(F.xxhash64("key", "n"), F.lit(runs)).cast("int").alias("run")
    firsts = marks.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"))
    copies = write_table(spark, "copies", marks.join(firsts, "digest").where("key > first").select(
        own, F.col("key").alias("k"), "n", "first", F.unhex("digest").alias("digest")))

    def copied(table: pa.Table) -> pa.Table:
        known = np.empty(table.num_rows, _COPY)
        for name, column in (("key", "k"), ("size", "n"), ("first", "first")):
            known[name] = table[column].to_numpy()
        known["digest"] = np.frombuffer(b"".join(table["digest"].to_pylist()), "V32")
        data = sorted({row.tobytes() for row in known})
        return _table(table["run"][0].as_py(), "copy", [(0, b"".join(data))])

    def first_pass(table: pa.Table, control: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(0, "", [])
        name, run, _ = _run(table, control)
        hashes = np.unique(method.anchors(run).hashes)
        part = bucket_of(hashes, runs)  # hashes are sorted, so buckets are runs of them
        edges = np.searchsorted(part, np.arange(runs + 1, dtype=np.uint64))
        return _table(name, "hash", [(b, _six(np.sort(hashes[i:j] & _LOW)))
                                     for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if i < j])

    def recur(table: pa.Table) -> pa.Table:
        who, parts = table["run"].to_pylist(), [_eight(d) for d in table["data"].to_pylist()]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        held = [(r, p[np.isin(p, twice, assume_unique=True)]) for r, p in zip(who, parts)]
        held = [(r, p) for r, p in held if len(p)]
        bucket = table["bucket"][0].as_py()
        return _table([r for r, _ in held], "again", [(bucket, _six(p)) for _, p in held])

    def second_pass(table: pa.Table, control: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(0, "", [])
        name, run, said = _run(table, control)
        found, bucket = _recurring(method.anchors(run), runs, said["again"])
        return _table(name, "entry", list(method.entries(run, found, bucket).messages.items()))

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table["run"].to_numpy(), kind="stable").tolist()
        who, data = table["run"].to_pylist(), table["data"].to_pylist()
        made = method.merge([data[i] for i in order])
        bucket = table["bucket"][0].as_py()
        return _table([who[i] for i in order], "verdict", [(bucket, d) for d in made])

    def last_pass(table: pa.Table, control: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        _, run, said = _run(table, control)
        found, bucket = _recurring(method.anchors(run), runs, said["again"])
        out = method.results(run, found, method.entries(run, found, bucket), said["verdict"])
        return out if run.rest is None else out.append_column("rest", run.rest)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()
    texts = rows.select(own, "key", "text", *more).groupBy("run")
    known = copies.groupBy("run").applyInArrow(copied, _MESSAGES)

    def by_run(control: DataFrame, step: Callable, out: str) -> DataFrame:
        return texts.cogroup(control.groupBy("run")).applyInArrow(step, out)

    hashes = by_run(known, first_pass, _MESSAGES)
    again = hashes.groupBy("bucket").applyInArrow(recur, _MESSAGES)
    entries = by_run(known.unionByName(again), second_pass, _MESSAGES)
    verdicts = entries.groupBy("bucket").applyInArrow(merge, _MESSAGES)
    return by_run(known.unionByName(again).unionByName(verdicts), last_pass, schema)
