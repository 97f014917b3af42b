"""Random walks, uniform and biased: one join a step, seeded by hashes, so that a seed gives the same walks anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.runtime import cut


def steps_from(graph: PropertyGraph, type_: str | None = None, direction: str = "out") -> DataFrame:
    """near, far, rel: one row for each relationship and way to go along it."""
    rels = graph.rels if type_ is None else graph.rels.where(F.col("type") == type_)
    out = rels.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.col("id").alias("rel"))
    back = rels.select(F.col("dst").alias("near"), F.col("src").alias("far"), F.col("id").alias("rel"))
    if direction == "out":
        return out
    return back if direction == "in" else out.unionByName(back.where("near <> far"))


def random_walks(graph: PropertyGraph, starts: DataFrame, steps: int, type_: str | None = None, direction: str = "out", seed: int = 0, number: int = 1, every: int = 8) -> DataFrame:
    """start, n, walk: `number` walks from each start, with at most `steps` steps; a dead end ends a walk.

    Each step takes the candidate with the least hash of (seed, walk, step, relationship), which is uniform over
    the relationships and needs no collected neighbour lists.
    """
    if steps < 0 or number < 1:
        raise GraphError("INVALID_ARGUMENT", "steps and number of walks")
    edges = steps_from(graph, type_, direction)
    walks = starts.select("start").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn("at", F.col("start")).withColumn("walk", F.array("start")).withColumn("on", F.lit(True))
    for k in range(steps):
        draw = F.xxhash64(F.lit(seed), "start", "n", F.lit(k), "rel")
        step = walks.where("on").join(edges, F.col("at") == F.col("near")).groupBy("start", "n").agg(F.min_by("far", F.struct(draw, "rel")).alias("next"))
        walks = walks.join(step, ["start", "n"], "left")
        walks = walks.select("start", "n", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNotNull(), F.array_append("walk", F.col("next"))).otherwise(F.col("walk")).alias("walk"), (F.col("on") & F.col("next").isNotNull()).alias("on"))
        if (k + 1) % every == 0 and k + 1 < steps:
            walks = cut(walks)
    return walks.select("start", "n", "walk")


def random_walk(graph: PropertyGraph, start: int, steps: int, type_: str | None = None, direction: str = "out", seed: int = 0) -> list[int]:
    graph.node(start)
    starts = graph.spark.createDataFrame([(start,)], "start long")
    return random_walks(graph, starts, steps, type_, direction, seed).first()["walk"]


def node2vec_walks(graph: PropertyGraph, steps: int, number: int, p: float, q_: float, type_: str | None = None, direction: str = "both", seed: int = 0) -> DataFrame:
    """start, n, walk from all nodes, with the second-order bias: weight 1/p back, 1 to a neighbour of the last node, 1/q else.

    A draw is the least -log(u) / weight over the candidates, which picks each in proportion to its weight.
    """
    edges = cut(steps_from(graph, type_, direction))
    pairs = edges.select(F.col("near").alias("a"), F.col("far").alias("b")).distinct()
    walks = graph.nodes.select(F.col("id").alias("start")).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumns({"last": F.lit(None).cast("long"), "at": F.col("start"), "walk": F.array("start"), "on": F.lit(True)})
    for k in range(steps):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "start", "n", F.lit(k), "rel"), 11) + 1) / float(1 << 53)
        cand = walks.where("on").join(edges, F.col("at") == F.col("near"))
        cand = cand.join(pairs, (F.col("last") == F.col("a")) & (F.col("far") == F.col("b")), "left")
        weight = F.when(F.col("last").isNull(), 1.0).when(F.col("far") == F.col("last"), 1.0 / p).when(F.col("a").isNotNull(), 1.0).otherwise(1.0 / q_)
        step = cand.groupBy("start", "n").agg(F.min_by("far", F.struct(-F.log(u) / weight, "rel")).alias("next"))
        walks = walks.join(step, ["start", "n"], "left")
        walks = cut(walks.select("start", "n", F.col("at").alias("last"), F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNotNull(), F.array_append("walk", F.col("next"))).otherwise(F.col("walk")).alias("walk"), (F.col("on") & F.col("next").isNotNull()).alias("on")))
    return walks.select("start", "n", "walk")
