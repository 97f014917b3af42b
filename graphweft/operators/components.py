"""Components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.graph import PropertyGraph
from graphweft.operators.edges import adjacency, steps_from, undirected
from graphweft.runtime import cut, numbered


def _dense(labels: DataFrame) -> DataFrame:
    """id, component: 0, 1, ... in the order of the least member."""
    firsts = labels.groupBy("label").agg(F.min("id").alias("first"))
    return labels.join(numbered(firsts, [F.col("first")], "component").select("label", "component"), "label").select("id", "component")


def least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id that reaches the node along edges near -> far. Labels spread and jump each round."""
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = edges.join(labels, F.col("near") == F.col("id")).groupBy("far").agg(F.min("label").alias("seen"))
        spread = labels.join(near, F.col("id") == F.col("far"), "left").select("id", F.least("label", F.coalesce("seen", "label")).alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("next"))
        new = cut(spread.join(jump, F.col("label") == F.col("at"), "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "was"))
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return labels


def weakly_connected(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id, component."""
    return _dense(least_labels(graph.nodes, cut(adjacency(undirected(graph, type_)))))


def strongly_connected(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id, component. Each round colours nodes by the least id that reaches them; whoever reaches back to it, inside
    the colour, is its component; the rest goes on."""
    left = cut(graph.nodes.select("id"))
    edges = cut(steps_from(graph, type_).where("near <> far").select("near", "far").distinct())
    done = None
    while not left.isEmpty():
        colour = least_labels(left, edges)
        a, b = colour.select(F.col("id").alias("near"), F.col("label").alias("c")), colour.select(F.col("id").alias("far"), F.col("label").alias("c2"))
        inside = cut(edges.join(a, "near").join(b, "far").where("c = c2").select("near", "far"))
        found = cut(colour.where("id = label"))
        frontier = found
        while True:
            back = frontier.join(inside, F.col("id") == F.col("far")).select(F.col("near").alias("id"), "label").distinct()
            frontier = cut(back.join(found.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            found = cut(found.unionByName(frontier))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found.select("id"), "id", "left_anti"))
        edges = cut(edges.join(left.select(F.col("id").alias("near")), "near", "left_semi").join(left.select(F.col("id").alias("far")), "far", "left_semi"))
    return _dense(done) if done is not None else left.withColumn("component", F.lit(0).cast("long"))


def label_propagation(graph: PropertyGraph, type_: str | None = None, iterations: int = 10) -> DataFrame:
    """id, label: all nodes take the most frequent label around them at once, the least of equals; loners keep theirs."""
    edges = cut(adjacency(undirected(graph, type_)))
    labels = cut(graph.nodes.select("id", F.col("id").alias("label")))
    for _ in range(iterations):
        votes = edges.join(labels, F.col("far") == F.col("id")).groupBy("near", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("near").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("top"))
        new = cut(labels.join(best, F.col("id") == F.col("near"), "left").select("id", F.coalesce(-F.col("top.minus"), F.col("label")).alias("label"), F.col("label").alias("was")))
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            break
    return labels


def louvain(graph: PropertyGraph, type_: str | None = None, iterations: int = 10, resolution: float = 1.0) -> DataFrame:
    """id, community: local moving of modularity on one level. A half of the nodes, new each turn, may move, and of two
    nodes alone only one moves, which keeps them from swapping; the least community of equal gains is taken."""
    edges = cut(adjacency(undirected(graph, type_)))
    k = edges.groupBy(F.col("near").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    state = cut(graph.nodes.select("id").join(k, "id", "left").select("id", F.col("id").alias("community"), F.coalesce("k", F.lit(0)).alias("k")))
    double = edges.count()
    if not double:
        return state.select("id", "community")
    quiet = 0
    for turn in range(2 * iterations):
        total = state.groupBy("community").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
        links = edges.join(state.select("id", "community"), F.col("far") == F.col("id")).groupBy("near", "community").agg(F.count(F.lit(1)).alias("links"))
        own = state.join(total.select(F.col("community").alias("mine"), F.col("size").alias("mine_size")), F.col("community") == F.col("mine"))
        own = own.select(F.col("id").alias("near"), "mine", "mine_size", "k").where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        stay = own.select("near", F.col("mine").alias("community"), F.lit(0).cast("long").alias("links")).join(links, ["near", "community"], "left_anti")
        cand = links.unionByName(stay).join(own, "near").join(total, "community")
        # of two nodes alone, only the one with the larger label moves to the other
        cand = cand.where(~((F.col("mine_size") == 1) & (F.col("size") == 1) & (F.col("community") > F.col("mine"))))
        others = F.col("total") - F.when(F.col("community") == F.col("mine"), F.col("k")).otherwise(0)
        gain = F.col("links") - resolution * F.col("k") * others / float(double)
        best = cand.groupBy("near").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), (F.col("community") == F.col("mine")).alias("same"), (-F.col("community")).alias("minus"))).alias("top"))
        new = cut(state.join(best, F.col("id") == F.col("near"), "left").select("id", F.coalesce(-F.col("top.minus"), F.col("community")).alias("community"), "k", F.col("community").alias("was")))
        quiet = quiet + 1 if new.where("community <> was").isEmpty() else 0
        state = new.drop("was")
        if quiet == 4:
            break
    return state.select("id", "community")
