"""A corpus pipeline: language identification, line dedup, near-dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import bpe, common, decontaminate, language_id, line_dedup, near_dedup
from graphweft.llm.common import scratch, sweep, table


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """The rows with names that no operator's own columns clash with, and what gives the old names back."""
    names = {c: c if c in used else f"own_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the model rejects go. A null language gets the predicted one.

    Null and empty texts and texts without a letter are rejected. Rows are judged one by one: repeated rows and ids,
    null ids and ties change nothing. With no labelled row nothing is known, and all rows go. An empty table stays empty.
    """
    model = language_id.fit(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    rows, old = _apart(docs, "text", "lang")
    known = language_id.predict(rows, model).where("NOT rejected")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*old)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that one of a smaller id holds; n_chars, where there is one, follows.

    A null text becomes an empty one, and a text all of whose lines go stays as an empty one. Rows that repeat an id
    are one holder; rows without an id keep their lines. An empty table stays empty.
    """
    rows, old = _apart(docs, "doc_id", "text", "n_chars")
    left = line_dedup.dedup_lines(rows)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*old)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Texts without a word are linked with nothing and stay, and so do rows without an id. Rows that repeat an id all
    stay where that id is the least of their group. An empty table stays empty.
    """
    rows, old = _apart(docs, "doc_id", "text")
    return near_dedup.drop_near_duplicates(rows).select(*old)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and wordless texts hold none and stay; rows are judged one by one. An empty table, or an empty benchmark,
    takes nothing away.
    """
    rows, old = _apart(docs, "doc_id", "text")
    return decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark")).select(*old)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to: n_tokens, ids and decoded beside all columns but text and n_chars.

    Those names replace columns of the documents. Null and empty texts have no token. One row for each row.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars", "n_tokens", "ids", "decoded")]
    return bpe.bpe_tokens(docs).select(*kept, F.size("ids").cast("long").alias("n_tokens"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "decoded")


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: A model and tokenizers are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each written and read again in the shared folder.

    Once a stage is written, what it was made of is deleted: only the last stage's table is left.
    """
    docs, began = table(spark, sf_dir, "documents"), len(common._MADE)
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark, began, path)
    return docs
