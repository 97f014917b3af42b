"""WARC records, and a Merkle fixity audit of replicas.

A shard holds the records of a fixed range of ids, one after the other; a record's offsets are places in its shard.
Each shard is a file, compressed as a whole; readers take records by their Content-Length, never by what a body holds.
The tree is sparse over the ids: node k of a level covers the 16 nodes 16 k ... 16 k + 15 below it, with the shards
and offsets of its records. Two replicas are compared from the root, and only mismatching branches are descended.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.common import cut, scratch, table

#: Ids in a shard.
SHARD_IDS = 1000
#: A node has 2 ** FAN children at most.
FAN = 4
CRLF = "\r\n"
#: The date of records whose table tells none.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(ident: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record. A null id, address or body is an empty one; line breaks in an address become blanks."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(ident.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.translate(F.coalesce(url, F.lit("")), CRLF, "  "), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF * 2),
    )


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record for each row: id, shard, start, length, record.

    Records of a shard lie in the order of their ids; rows that repeat an id in that of their bytes. Rows without an
    id go to shards of their own, dealt by a hash. An empty table makes no record.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    rows = pages.select(ident.alias("id"), record_bytes(ident, F.col(f"`{url_col}`"), F.col(f"`{html_col}`")).alias("record"))
    shard = F.coalesce(F.floor(F.col("id") / F.lit(SHARD_IDS)).cast("long"), -1_000_000_000_000 - F.pmod(F.xxhash64("record"), F.lit(4096)))
    sized = rows.select("id", shard.alias("shard"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"), "record")
    within = Window.partitionBy("shard").orderBy("id", "sha256").rowsBetween(Window.unboundedPreceding, 0)
    return sized.select("id", "shard", (F.sum("length").over(within) - F.col("length")).alias("start"), "length", "record")


def write_files(records: DataFrame, path: str, placed: bool = False) -> None:
    """A file for each shard: its records' bytes in the order of their offsets.

    placed: all rows of a shard are in one partition already, as archive() and read_files() leave them. The line
    writer puts each record's last newline.
    """
    rows = records if placed else records.repartition("shard")
    value = F.expr("substring(CAST(record AS STRING), 1, length(CAST(record AS STRING)) - 1)")
    rows.sortWithinPartitions("shard", "start").select("shard", value.alias("value")).write.partitionBy("shard").option("lineSep", "\n").option("compression", "gzip").text(path)


_END = b"\r\n\r\n"
_NEXT = _END + b"WARC/1."
_LENGTH = re.compile(rb"^Content-Length: *([0-9]+) *\r?$", re.I | re.M)
_IDENT = re.compile(rb"^WARC-Record-ID: *<urn:page:(-?[0-9]{1,18})> *\r?$", re.I | re.M)


def split_records(data: bytes) -> Iterator[tuple[int, int, int | None, bool]]:
    """start, length, id and whether it is sound, of each record of a file.

    A record is as long as its head says. Where the head says nothing, or leads past the end, the record is not sound
    and ends before the next head.
    """
    at = 0
    while at < len(data):
        head = data.find(_END, at)
        length = _LENGTH.search(data, at, head + 2) if head >= 0 else None
        ident = _IDENT.search(data, at, head + 2) if head >= 0 else None
        end = head + 8 + int(length[1]) if length else len(data) + 1
        sound = data.startswith(b"WARC/1.", at) and end <= len(data) and data[end - 4 : end] == _END
        if end > len(data):
            near = data.find(_NEXT, at + 1)
            end = near + 4 if near >= 0 else len(data)
        yield at, end - at, int(ident[1]) if ident else None, sound
        at = end


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of shard files as id, shard, start, length, record (binary) and valid; a shard to a task.

    Offsets are places in the files' bytes. A body may hold anything, records' heads included. A folder without files
    has no record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    shard = F.regexp_extract("path", "shard=(-?[0-9]+)", 1).cast("long")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, content in zip(batch.column(0), batch.column(1), strict=True):
                data = gzip.decompress(content.as_buffer())
                found = list(split_records(data))
                for k in range(0, len(found), 256):
                    start, length, ident, sound = zip(*found[k : k + 256], strict=True)
                    record = [data[a : a + n] for a, n in zip(start, length, strict=True)]
                    columns = [pa.array(ident, pa.int64()), pa.array([own.as_py()] * len(start), pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(record, pa.binary()), pa.array(sound)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "shard", "start", "length", "record", "valid"])

    return files.select(shard.alias("shard"), "content").mapInArrow(parse, "id long, shard long, start long, length long, record binary, valid boolean")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: a node for each (shard, id), null-safe: key, and a digest of the records and their offset ranges.

    Records that repeat an id are added up (four 64-bit sums over their digests), which merges before the shuffle.
    """
    digest = F.sha2(F.concat_ws(":", F.sha2("record", 256), F.col("start").cast("string"), F.col("length").cast("string"), F.col("shard").cast("string")), 256)
    sums = [F.sum(F.conv(F.substring("d", 1 + 16 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    # a row without an id hangs below its shard's number, which no id has
    keyed = records.select(F.coalesce("id", "shard").alias("key"), digest.alias("d"))
    return keyed.groupBy("key").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("hash"))


def raised(level: DataFrame) -> DataFrame:
    """The level above: each node hashes its children, in order."""
    return level.groupBy(F.shiftright("key", FAN).alias("key")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "hash"))), lambda c: F.concat(c["key"].cast("string"), F.lit("="), c["hash"])), ";"), 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots (one for ids from 0, one for those below 0)."""
    levels = [cut(leaves(records))]
    while True:
        low, high = levels[-1].agg(F.min("key"), F.max("key")).first()
        if low is None or (low >= -1 and high <= 0):
            return levels
        levels.append(cut(raised(levels[-1])))


def audit(good: DataFrame, other: DataFrame) -> DataFrame:
    """Keys of leaves (ids, or shards of records without one) whose records differ, are missing or are too many."""
    a, b = tree(good), tree(other)
    while len(a) < len(b):
        a.append(cut(raised(a[-1])))
    while len(b) < len(a):
        b.append(cut(raised(b[-1])))
    wrong = None
    for left, right in zip(reversed(a), reversed(b), strict=True):
        if wrong is not None:
            left, right = (x.join(wrong.withColumnRenamed("key", "parent"), F.shiftright(x.key, FAN) == F.col("parent"), "left_semi") for x in (left, right))
        both = left.select("key", F.col("hash").alias("left")).join(right.select("key", F.col("hash").alias("right")), "key", "full_outer")
        wrong = cut(both.where(~F.col("left").eqNullSafe(F.col("right"))).select("key"))
    return wrong


def damaged(records: DataFrame, each: int = 50, rest: int = 7) -> DataFrame:
    """A replica in which one byte of every record with id mod `each` = `rest` has changed."""
    spoilt = F.expr("concat(X'58', substring(CAST(record AS BINARY), 2, octet_length(record)))")
    return records.withColumn("record", F.when(F.pmod(F.col("id"), F.lit(each)) == rest, spoilt).otherwise(F.col("record").cast("binary")))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to WARC files, spoil a replica of these, and audit it from its files: where each record lies and
    whether its replica is intact."""
    good, other = scratch(spark, "warc"), scratch(spark, "warc-replica")
    write_files(archive(table(spark, sf_dir, "pages")), good, placed=True)
    records = read_files(spark, good)
    write_files(damaged(records), other, placed=True)
    wrong = audit(records, read_files(spark, other)).withColumnRenamed("key", "wrong_key")
    marked = records.select("id", "shard", "start", "length", F.sha2("record", 256).alias("sha256")).join(wrong, F.coalesce("id", "shard") == F.col("wrong_key"), "left")
    return marked.select(F.col("id").alias("page_id"), "shard", "start", "length", "sha256", F.col("wrong_key").isNull().alias("intact"))


ORACLE = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
s AS (SELECT page_id, CAST(floor(page_id / 1000.0) AS BIGINT) AS shard, CAST(octet_length(encode(record)) AS BIGINT) AS length, sha256(record) AS sha256 FROM r)
SELECT page_id, shard, CAST(sum(length) OVER (PARTITION BY shard ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS start,
       length, sha256, page_id % 50 <> 7 AS intact
FROM s
"""
