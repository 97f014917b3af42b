"""Procedures for CALL ... YIELD: the built-in one, and wrapped Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.errors import parse_error
from graphweft.graph import q
from graphweft.operators.walks import random_walks
from graphweft.values import spark_type


def wrapped(function: Callable, fields: dict[str, Any]) -> Callable:
    """A procedure that calls `function` for each row, in Arrow batches on the executors."""

    def call(compiler, frame, bound, args, pos) -> dict:
        inputs = [c.alias(f"arg_{k}") for k, (c, _) in enumerate(bound)]
        df = frame.df.select("*", *inputs)
        made = T.StructType([T.StructField(pos, T.IntegerType()), *[T.StructField(f"y_{f}", spark_type(t)) for f, t in fields.items()]])
        n = len(bound)

        @F.pandas_udf(T.ArrayType(made))
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = batch.iloc[:, :n].itertuples(index=False) if n else [()] * len(batch)
                yield pd.Series([[(k, *row) for k, row in enumerate(function(*[None if x is pd.NA or (isinstance(x, float) and x != x) else x for x in r]))] for r in rows])

        fed = F.struct(*[q(f"arg_{k}") for k in range(n)]) if n else F.struct(F.lit(0).alias("none"))
        out = df.withColumn("made", F.explode(run(fed)))
        return {"df": out.select(*[q(c) for c in frame.df.columns], "made.*"), "types": fields}

    return call


def _random_walk(compiler, frame, bound, args, pos) -> dict:
    if len(args) not in (2, 3):
        raise parse_error("randomWalk(node, steps[, seed])")
    if bound[0][1] not in ("node", "int") or any(t != "int" for _, t in bound[1:]):
        raise parse_error("randomWalk(node, steps[, seed]) takes a node and whole numbers")
    values = []
    for a in args[1:]:
        if a[0] not in ("lit", "param"):
            raise parse_error("steps and seed are literals or parameters")
        values.append(a[1] if a[0] == "lit" else compiler.params[a[1]])
    start = bound[0][0]
    starts = frame.df.select(start.cast("long").alias("start")).where("start is not null").distinct()
    walks = random_walks(compiler.graph, starts, values[0], seed=values[1] if len(values) > 1 else 0)
    walks = walks.select(F.col("start").alias("walk_start"), F.posexplode("walk").alias(pos, "y_node"))
    return {"df": frame.df.join(walks, start == F.col("walk_start")).drop("walk_start"), "types": {"node": "node"}}


BUILT_IN = {"randomWalk": _random_walk}
