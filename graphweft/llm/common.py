"""Shared helpers: table access, the shared work folder, and byte views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised block holds at most (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and one JVM does all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = known.get() if known.isDefined() else f"file://{tempfile.gettempdir()}/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths that scratch() gave and sweep() has not deleted, oldest first.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def sweep(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the tables written after the first `since` of those that are left, but for `keep`.

    For callers who have written their results: a lazy result may still read them.
    """
    for path in [p for p in _MADE[since:] if p != keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder, and read it: lineage is cut, and the files are compressed."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: hand fewer rows at a time to Python workers than Spark does by default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the built-in lower() is the same for pure ASCII and much faster."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def text_blocks(batches: Iterator[pa.RecordBatch], text_col: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text_col))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets into them; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: A 64-bit value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_words(data: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts. code: for each byte its normalised byte, 0 where a byte parts words.

    Returns each word's 64-bit hash, its text's index, and its first byte and length in `data`.
    """
    kept = code[data]
    inside = kept > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    kept = kept[inside]
    where = np.cumsum(inside)[starts] - 1  # of the first byte, among the kept
    lengths = np.diff(np.append(where, len(kept)))
    pos = np.arange(len(kept)) - np.repeat(where, lengths)
    hashes = np.add.reduceat(BYTE_VALUE[kept] * powers(int(lengths.max()))[pos], where)
    texts = np.searchsorted(offsets, starts, side="right") - 1
    return mix64(hashes), texts, starts, lengths
