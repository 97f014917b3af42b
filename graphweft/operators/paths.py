"""Traversal and paths: frontiers that grow by one join a round, cut each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.operators.edges import steps_from, weighted
from graphweft.runtime import cut


def distances(graph: PropertyGraph, sources: DataFrame, type_: str | None = None, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """source, id, depth for all nodes that breadth-first search reaches from each source (column source)."""
    edges = steps_from(graph, type_, direction).select("near", "far").distinct()
    frontier = cut(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("id") == F.col("near")).select("source", F.col("far").alias("id")).distinct()
        frontier = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    return seen


def traverse(graph: PropertyGraph, start: int, type_: str | None = None, direction: str = "out", max_depth: int | None = None, visit_limit: int = 0) -> DataFrame:
    """id, depth: each node once, the start at depth 0, by depth and id; visit_limit 0 is no limit."""
    graph.node(start)
    out = distances(graph, graph.spark.createDataFrame([(start,)], "source long"), type_, direction, max_depth).select("id", "depth")
    return out.orderBy("depth", "id").limit(visit_limit) if visit_limit else out.orderBy("depth", "id")


def bfs_path(graph: PropertyGraph, start: int, goal: int, type_: str | None = None, direction: str = "out") -> list[int]:
    """Nodes of a shortest path, of equal ones the least; NOT_FOUND where there is none."""
    for node in (start, goal):
        graph.node(node)
    edges = steps_from(graph, type_, direction).select("near", "far").distinct()
    frontier = graph.spark.createDataFrame([(start, [start])], "id long, path array<long>")
    seen = frontier.select("id")
    while True:
        found = frontier.where(F.col("id") == goal).first()
        if found:
            return list(found["path"])
        step = frontier.join(edges, F.col("id") == F.col("near")).join(seen.withColumnRenamed("id", "old"), F.col("far") == F.col("old"), "left_anti")
        frontier = cut(step.groupBy(F.col("far").alias("id")).agg(F.min(F.array_append("path", F.col("far"))).alias("path")))
        if frontier.isEmpty():
            raise GraphError("NOT_FOUND", f"no path from {start} to {goal}", count=0)
        seen = cut(seen.unionByName(frontier.select("id")))


def shortest_distances(graph: PropertyGraph, start: int, weight: str, type_: str | None = None, direction: str = "out", goal: int | None = None, heuristic: Column | None = None) -> DataFrame:
    """id, distance, path: relaxation rounds from the start, where only nodes that got nearer go on.

    With a goal, nodes that cannot beat the goal's best distance so far (plus `heuristic`, a lower bound of the rest
    over column id) are left out.
    """
    graph.node(start)
    edges = weighted(graph, weight, type_, direction)
    edges = cut(edges.groupBy("near", "far").agg(F.min("weight").alias("weight")))
    state = cut(graph.spark.createDataFrame([(start, 0.0, [start])], "id long, distance double, path array<long>"))
    frontier = state
    while True:
        step = frontier.join(edges, F.col("id") == F.col("near")).select(F.col("far").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), F.array_append("path", F.col("far")).alias("path"))
        if goal is not None:
            best = state.where(F.col("id") == goal).first()
            if best:
                ahead = heuristic if heuristic is not None else F.lit(0.0)
                step = step.where(F.col("distance") + ahead <= best["distance"])
        least = step.groupBy("id").agg(F.min(F.struct("distance", "path")).alias("new"))
        known = state.select("id", F.col("distance").alias("old"))
        frontier = cut(least.join(known, "id", "left").where("old is null or new.distance < old").select("id", "new.distance", "new.path"))
        if frontier.isEmpty():
            return state
        state = cut(state.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))


def dijkstra(graph: PropertyGraph, start: int, goal: int, weight: str, type_: str | None = None, direction: str = "out") -> tuple[list[int], float]:
    graph.node(goal)
    found = shortest_distances(graph, start, weight, type_, direction, goal).where(F.col("id") == goal).first()
    if found is None:
        raise GraphError("NOT_FOUND", f"no path from {start} to {goal}", count=0)
    return list(found["path"]), found["distance"]


def a_star(graph: PropertyGraph, start: int, goal: int, weight: str, heuristic: Callable[[Column], Column], type_: str | None = None, direction: str = "out") -> tuple[list[int], float]:
    """heuristic: column of ids -> lower bound of the distance to the goal."""
    graph.node(goal)
    found = shortest_distances(graph, start, weight, type_, direction, goal, heuristic(F.col("id"))).where(F.col("id") == goal).first()
    if found is None:
        raise GraphError("NOT_FOUND", f"no path from {start} to {goal}", count=0)
    return list(found["path"]), found["distance"]


def simple_paths(graph: PropertyGraph, start: int, goal: int, max_depth: int, max_paths: int = 0, type_: str | None = None, direction: str = "out") -> DataFrame:
    """path: all paths without a repeated node, shorter first, of at most max_depth steps (0: no limit on their number)."""
    graph.node(start), graph.node(goal)
    edges = cut(steps_from(graph, type_, direction).select("near", "far", "rel"))
    level = graph.spark.createDataFrame([(start, [start], [])], "at long, path array<long>, rels array<long>")
    out = level.where(F.col("at") == goal) if start == goal else None
    for _ in range(max_depth):
        step = level.where(F.col("at") != goal).join(edges, F.col("at") == F.col("near")).where(~F.array_contains("path", F.col("far")))
        level = cut(step.select(F.col("far").alias("at"), F.array_append("path", F.col("far")).alias("path"), F.array_append("rels", F.col("rel")).alias("rels")))
        if level.isEmpty():
            break
        hit = level.where(F.col("at") == goal)
        out = hit if out is None else out.unionByName(hit)
    out = level.limit(0) if out is None else out
    out = out.select("path", "rels").orderBy(F.size("path"), "path", "rels")
    return out.limit(max_paths) if max_paths else out


def topological_levels(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id, level (longest path that ends there). A cycle is EXISTS."""
    edges = cut(steps_from(graph, type_).select("near", "far").distinct())
    left, level = cut(graph.nodes.select("id")), 0
    out = None
    while not left.isEmpty():
        free = cut(left.join(edges.select(F.col("far").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise GraphError("EXISTS", "the graph has a cycle", count=graph.node_count())
        out = free if out is None else out.unionByName(free)
        gone = free.select(F.col("id").alias("near"))
        edges = cut(edges.join(gone, "near", "left_anti"))
        left = cut(left.join(free.select("id"), "id", "left_anti"))
        level += 1
    return out if out is not None else left.withColumn("level", F.lit(0))


def topological_sort(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    return topological_levels(graph, type_).orderBy("level", "id")
