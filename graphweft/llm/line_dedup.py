"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import ASCII_SPACE, ascii_lower, row_key, table


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop each line that at least `min_docs` documents share, but in the smallest id that holds it.

    Returns the rows of `docs` with the text replaced by the kept lines, and n_lines and n_dropped (which
    replace columns of those names). A null text is one empty line and comes back as an empty text. Lines whose
    key is shorter than `min_chars` code points stay. Rows that repeat an id count as one document and are cut
    each by itself. A row without an id keeps all its lines and counts for none. An empty table stays empty.

    Hashes are 128 bits wide. The first shuffle holds one row a key and task (minimum and maximum of the id are
    combined before it), so a line in a third of all rows is no hot key; the join back to the lines is a plain
    inner join, which adaptive execution splits where a key is hot.
    """
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(ident.alias("__id"), row_key(id_col, text_col).alias("__row"), F.split(text, "\n", -1).alias("__lines"))
    lines = (
        base.where(F.col("__id").isNotNull())
        .select("__id", "__row", F.posexplode("__lines").alias("__pos", "__line"))
        .select("__id", "__row", "__pos", line_key(F.col("__line")).alias("__key"))
        .where(F.length("__key") >= min_chars)
        .select("__id", "__row", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(0x51ED), "__key").alias("__h2"))
    )
    if min_docs <= 2:
        keys = lines.groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last" if min_docs == 2 else "true")
    else:
        keys = lines.groupBy("__h1", "__h2", "__id").agg(F.lit(1).alias("__one")).groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.count("__one").alias("__n")).where(F.col("__n") >= min_docs)
    dropped = (
        lines.join(keys.select("__h1", "__h2", "__first"), ["__h1", "__h2"])
        .where(F.col("__id") != F.col("__first"))
        .groupBy("__id", "__row")
        .agg(F.collect_set("__pos").alias("__gone"))
        .select("__row", F.col("__id").alias("__of"), "__gone")
    )
    whole = docs.withColumn("__row", row_key(id_col, text_col))
    joined = whole.join(dropped.withColumnRenamed("__row", "__key_row"), (F.col(f"`{id_col}`") == F.col("__of")) & (F.col("__row") == F.col("__key_row")), "left")
    split = joined.withColumn("__lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {text_col: kept, "n_lines": F.size("__lines").cast("long"), "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")}
    return split.select(*[c.alias(name) for name, c in out.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (s.keeper IS NOT NULL AND s.keeper <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
