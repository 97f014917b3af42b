"""Views of relationships that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import P, PropertyGraph, q
from graphweft.operators.walks import steps_from

__all__ = ["adjacency", "degrees", "rels_of", "steps_from", "undirected", "weighted"]


def rels_of(graph: PropertyGraph, type_: str | None) -> DataFrame:
    """Relationships of a type, or all. A type that the graph has not is NOT_FOUND."""
    if type_ is None:
        return graph.rels
    out = graph.rels.where(F.col("type") == type_)
    if out.limit(1).count() == 0:
        raise GraphError("NOT_FOUND", f"no relationship of type {type_}")
    return out


def undirected(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """a < b: each pair of linked nodes once, without loops."""
    rels = graph.rels if type_ is None else graph.rels.where(F.col("type") == type_)
    return rels.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def adjacency(pairs: DataFrame) -> DataFrame:
    """near, far: both directions of undirected pairs."""
    return pairs.select(F.col("a").alias("near"), F.col("b").alias("far")).unionByName(pairs.select(F.col("b").alias("near"), F.col("a").alias("far")))


def degrees(pairs: DataFrame) -> DataFrame:
    """id, k: distinct neighbours."""
    return adjacency(pairs).groupBy(F.col("near").alias("id")).agg(F.count(F.lit(1)).alias("k"))


def weighted(graph: PropertyGraph, key: str, type_: str | None = None, direction: str = "out") -> DataFrame:
    """near, far, rel, weight. A missing weight is NOT_FOUND, a negative or non-numeric one INVALID_ARGUMENT."""
    if graph.types("rel").get(key) not in ("int", "double"):
        raise GraphError("INVALID_ARGUMENT", f"{key} is no numeric property of relationships")
    rels = graph.rels if type_ is None else graph.rels.where(F.col("type") == type_)
    weight: Column = q(P + key).cast("double")
    worst = rels.agg(F.min(weight).alias("low"), F.count_if(weight.isNull()).alias("missing")).first()
    if worst["missing"]:
        raise GraphError("NOT_FOUND", f"{worst['missing']} relationships have no {key}")
    if worst["low"] is not None and worst["low"] < 0:
        raise GraphError("INVALID_ARGUMENT", f"negative {key}")
    out = rels.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.col("id").alias("rel"), weight.alias("weight"))
    back = rels.select(F.col("dst").alias("near"), F.col("src").alias("far"), F.col("id").alias("rel"), weight.alias("weight"))
    if direction == "out":
        return out
    return back if direction == "in" else out.unionByName(back.where("near <> far"))
