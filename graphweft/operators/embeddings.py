"""Node embeddings: FastRP and Node2Vec-style. Seeded by hashes: the same everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.operators.edges import steps_from
from graphweft.operators.walks import node2vec_walks
from graphweft.runtime import cut


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _signs(seed: int, dims: int, key: str) -> Column:
    """A sparse random vector of an id: each entry is +1, -1 (one in six each) or 0, scaled."""
    def entry(i: int) -> Column:
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(6))
        return F.when(h == 0, 3**0.5).when(h == 1, -(3**0.5)).otherwise(0.0)

    return F.array(*[entry(i) for i in range(dims)])


def _mean(dims: int, c: str) -> Column:
    return F.array(*[F.avg(F.get(c, i)) for i in range(dims)])


def fastrp(graph: PropertyGraph, dims: int = 64, weights: Sequence[float] = (0.0, 1.0, 1.0), type_: str | None = None, direction: str = "both", seed: int = 0) -> DataFrame:
    """id, vector: weighted sum of unit vectors of 0, 1, 2, ... rounds of neighbour means of sparse random vectors.

    weights[0] is that of the random vectors themselves; a node without neighbours keeps them.
    """
    if dims < 1 or not weights:
        raise GraphError("INVALID_ARGUMENT", "dimensions and weights")
    edges = cut(steps_from(graph, type_, direction).select("near", "far"))
    now = cut(graph.nodes.select("id", _signs(seed, dims, "id").alias("v")))
    total = now.select("id", F.transform(_unit(F.col("v")), lambda x: x * weights[0]).alias("s"))
    for w in weights[1:]:
        mean = edges.join(now, F.col("far") == F.col("id")).groupBy("near").agg(_mean(dims, "v").alias("m"))
        now = cut(now.join(mean, F.col("id") == F.col("near"), "left").select("id", F.coalesce("m", "v").alias("v")))
        part = now.select("id", _unit(F.col("v")).alias("u"))
        total = cut(total.join(part, "id").select("id", F.zip_with("s", "u", lambda a, b: a + b * w).alias("s")))
    return total.select("id", _unit(F.col("s")).alias("vector"))


def node2vec(graph: PropertyGraph, dims: int = 64, steps: int = 8, number: int = 4, p: float = 1.0, q: float = 1.0, window: int = 3, type_: str | None = None, direction: str = "both", seed: int = 0) -> DataFrame:
    """id, vector: biased walks, then the mean random vector of what stands within `window` steps, at unit length."""
    walks = cut(node2vec_walks(graph, steps, number, p, q, type_, direction, seed))
    placed = walks.select("start", "n", F.posexplode("walk").alias("at", "id"))
    a, b = placed, placed.select(F.col("start").alias("s2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("id").alias("ctx"))
    near = a.join(b, (F.col("start") == F.col("s2")) & (F.col("n") == F.col("n2"))).where((F.abs(F.col("at") - F.col("at2")) <= window) & (F.col("at") != F.col("at2")))
    counted = near.groupBy("id", "ctx").agg(F.count(F.lit(1)).alias("c"))
    vec = counted.select("id", "c", _signs(seed, dims, "ctx").alias("v"))
    sums = vec.groupBy("id").agg(F.array(*[F.sum(F.get("v", i) * F.col("c")) for i in range(dims)]).alias("v"))
    own = graph.nodes.select(F.col("id").alias("at_id"), _signs(seed, dims, "id").alias("own"))
    return own.join(sums, F.col("at_id") == F.col("id"), "left").select(F.col("at_id").alias("id"), _unit(F.coalesce("v", "own")).alias("vector"))
