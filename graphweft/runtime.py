"""Session helpers: the shared work folder, cutting lineage, and dense row numbers without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.errors import GraphError


def session(**conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.config(map=base | conf).getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, which all executors share; a local folder only where it is unset and one JVM does all."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.isLocal():
            raise GraphError("INVALID_ARGUMENT", "spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/checkpoints")
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it: lineage is cut, and joins plan by the table's true size."""
    path = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    """Rows numbered first, first + 1, ... by `order`: a distributed sort, then each partition's offset.

    Only one number for each partition comes to the driver.
    """
    work_dir(df.sparkSession)
    rows = (df.orderBy(*order) if order else df).checkpoint(eager=True)  # keeps partitions and their order
    placed = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    offsets, total = {}, first
    for part in sorted(sizes):
        offsets[part], total = total, total + sizes[part]
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair])
    return placed.withColumn(name, F.element_at(starts, F.col("__part").cast("long")) + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at")
