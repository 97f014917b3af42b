"""Centrality: degree, PageRank, eigenvector, closeness, harmonic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.graph import PropertyGraph
from graphweft.operators.edges import rels_of, steps_from
from graphweft.operators.paths import distances
from graphweft.runtime import cut


def degree(graph: PropertyGraph, type_: str | None = None, direction: str = "out") -> DataFrame:
    """id, degree: relationships, for every node; a loop counts once where both directions count."""
    rels_of(graph, type_)
    counts = steps_from(graph, type_, direction).groupBy("near").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id").join(counts, F.col("id") == F.col("near"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pagerank(graph: PropertyGraph, type_: str | None = None, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """id, rank; ranks sum to 1. What nodes without an outgoing relationship hold is dealt out evenly.

    A round maps ranks r to d P r + c, with one number c for all nodes, which holds the dangling mass. So ranks are a
    weighted sum of the powers (d P)^j of the vector of ones: each power is one join and one sum, without the nodes that
    nothing flows into, and the weights follow at the end from the dangling mass of each power.
    """
    n = graph.node_count()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("rank"))
    edges = steps_from(graph, type_).select("near", "far")
    out_degree = cut(edges.groupBy("near").agg(F.count(F.lit(1)).alias("k")))
    edges = cut(edges.groupBy("near", "far").agg(F.count(F.lit(1)).alias("m")).join(out_degree, "near").select("near", "far", (damping * F.col("m") / F.col("k")).alias("share")).repartition("near"))
    powers = [cut(edges.groupBy(F.col("far").alias("id")).agg(F.sum("share").alias("x")))] if iterations else []
    for _ in range(iterations - 1):
        powers.append(cut(edges.join(powers[-1], F.col("near") == F.col("id")).groupBy(F.col("far").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))))
    # of the ones, and of each power but the last, which no further round reads
    dangling = [float(n - out_degree.count())] + [0.0] * (iterations - 1)
    every = None
    for j, p in enumerate(powers, 1):
        p = p.withColumn("j", F.lit(j))
        every = p if every is None else every.unionByName(p)
    if every is not None:
        for r in every.join(out_degree, F.col("id") == F.col("near"), "left_anti").where(F.col("j") < iterations).groupBy("j").agg(F.sum("x").alias("lost")).collect():
            dangling[r["j"]] = r["lost"]
    weights = [1.0 / n]  # of powers 0, 1, ... after as many rounds as there are weights less one
    for _ in range(iterations):
        lost = sum(w * x for w, x in zip(weights, dangling, strict=False))
        weights = [(1 - damping) / n + damping * lost / n, *weights]
    if every is None:
        return graph.nodes.select("id", F.lit(weights[0]).alias("rank"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("j") + 1)
    rows = every.select("id", (weight * F.col("x")).alias("rank")).unionByName(graph.nodes.select("id", F.lit(weights[0]).alias("rank")))
    return rows.groupBy("id").agg(F.sum("rank").alias("rank"))


def eigenvector(graph: PropertyGraph, type_: str | None = None, iterations: int = 20, direction: str = "both") -> DataFrame:
    """id, score: power iteration from equal scores, of length 1 after each round."""
    edges = cut(steps_from(graph, type_, direction).groupBy("near", "far").agg(F.count(F.lit(1)).alias("m")))
    scores = cut(graph.nodes.select("id", F.lit(1.0).alias("score")))
    for _ in range(iterations):
        flow = edges.join(scores, F.col("far") == F.col("id")).groupBy("near").agg(F.sum(F.col("score") * F.col("m")).alias("flow"))
        new = cut(scores.select("id").join(flow, F.col("id") == F.col("near"), "left").select("id", F.coalesce("flow", F.lit(0.0)).alias("score")))
        norm = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("x")).first()["x"]
        scores = new.select("id", (F.col("score") / norm).alias("score")) if norm else new
    return scores


def closeness(graph: PropertyGraph, type_: str | None = None, direction: str = "out", sources: DataFrame | None = None) -> DataFrame:
    """id, score = (r - 1) / sum of distances * (r - 1) / (n - 1), with r nodes reached (itself included); 0 alone.

    One breadth-first search from each source (all nodes, unless given) at the same time.
    """
    n = graph.node_count()
    start = graph.nodes.select(F.col("id").alias("source")) if sources is None else sources
    sums = distances(graph, start, type_, direction).groupBy("source").agg(F.sum("depth").alias("d"), F.count(F.lit(1)).alias("r"))
    score = F.when((F.col("d") > 0) & F.lit(n > 1), (F.col("r") - 1) / F.col("d") * (F.col("r") - 1) / max(n - 1, 1)).otherwise(0.0)
    return sums.select(F.col("source").alias("id"), score.alias("score"))


def harmonic(graph: PropertyGraph, type_: str | None = None, direction: str = "out", sources: DataFrame | None = None) -> DataFrame:
    """id, score = sum of 1 / distance over the others reached, / (n - 1)."""
    n = graph.node_count()
    start = graph.nodes.select(F.col("id").alias("source")) if sources is None else sources
    sums = distances(graph, start, type_, direction).groupBy("source").agg(F.sum(F.when(F.col("depth") > 0, 1.0 / F.col("depth")).otherwise(0.0)).alias("h"))
    return sums.select(F.col("source").alias("id"), (F.col("h") / max(n - 1, 1)).alias("score"))
