"""What the operators share: row identity, written stages, text buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["settle", "release", "recorded", "tuned", "keyed", "marked", "zipped", "unzipped", "slices", "blobs", "pieces", "text_rows"]


def tuned(spark: SparkSession) -> SparkSession:
    """Session options of the queries: Arrow batches of rows that hold whole texts are
    kept small, for they stand in memory twice, in the JVM and in Python; what a step has
    shuffled goes when the step ends, not when the driver next collects its garbage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


_RECORDS: list[list[DataFrame]] = []


def settle(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read back; see :func:`recorded`."""
    out = cut_lineage(df)
    for record in _RECORDS:
        record.append(out)
    return out


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The stages written meanwhile, for :func:`release` once their results are kept."""
    _RECORDS.append(made := [])
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def release(*stages: DataFrame) -> None:
    """Delete written stages that nothing needs any more: all that was made of them is
    itself written, so a lost executor never reads them again."""
    for stage in stages:
        context = stage.sparkSession.sparkContext
        for name in stage.inputFiles():
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False)


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns ``doc``, ``th``, ``text``: the id as long (it may be null or repeat), a
    hash of the text, and the text. ``(doc, th)`` is the identity of a row: rows that
    agree in both are copies under one id and get the same result."""
    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.alias("text"))


#: Bits at most of a table of :func:`marked`.
MARK_BITS = 1 << 27


def marked(rows: DataFrame, hashed: str) -> np.ndarray:
    """Bits of which those at the low bits of the column ``hashed``, a hash, are set."""
    size = min(MARK_BITS, 1 << max(10, (16 * rows.count()).bit_length()))
    at = F.col(hashed).bitwiseAND(size - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    table = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out


def zipped(base: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """:func:`keyed` rows with the text compressed, ``z``: what is shuffled or kept for
    later passes is then under half as large. With ``marks`` (see :func:`marked`) only rows
    whose ``th`` is marked, all that a join on those hashes needs, and a few more."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            if marks is not None:
                at = b.column("th").to_numpy() & (64 * len(marks) - 1)
                b = b.filter(pa.array((marks[at >> 6] >> (at & 63) & 1).astype(bool)))
            data, offsets = blobs(b.column("text"))
            body = memoryview(data)
            z = [pack(body[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([b.column("doc"), b.column("th"), pa.array(z, pa.binary())], names=["doc", "th", "z"])

    return base.select("doc", "th", "text").mapInArrow(run, "doc long, th long, z binary")


def unzipped(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column of :func:`zipped` texts, about ``size`` bytes each: first
    row, row after the last, their bytes, and offsets."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts: list[bytes] = []
    first, held = 0, 0
    n = len(column)
    for i in range(n):
        texts.append(unpack(column[i].as_buffer()))
        held += len(texts[-1])
        if held >= size or i + 1 == n:
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=offsets[1:])
            yield first, i + 1, np.frombuffer(b"".join(texts), np.uint8), offsets
            texts, first, held = [], i + 1, 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, where columns become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its row offsets; null is empty."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def text_rows(column: pa.Array) -> Iterator[str]:
    """Texts of a column one by one; null is empty."""
    for x in column:
        yield x.as_py() or ""
