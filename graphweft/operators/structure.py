"""Triangles, clustering, neighbour measures, k nearest neighbours, cut points, spanning trees, flow."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.operators.components import least_labels
from graphweft.operators.edges import adjacency, degrees, undirected, weighted
from graphweft.runtime import cut

#: Edges that the sequential operators (cut points, bridges, flow) collect at most; beyond it they raise LIMIT.
DRIVER_EDGES = 2_000_000


def _oriented(pairs: DataFrame) -> DataFrame:
    """lo, hi: from the end of lower degree (then id), so that no node has many outgoing edges."""
    k = degrees(pairs)
    both = pairs.join(k.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    forward = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    return both.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("hi"))


def triangles(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id, triangles: undirected, parallel relationships count once."""
    edges = cut(_oriented(undirected(graph, type_)))
    x = edges.select("lo", F.col("hi").alias("x"))
    y = edges.select(F.col("lo").alias("lo2"), F.col("hi").alias("y"))
    close = edges.select(F.col("lo").alias("c1"), F.col("hi").alias("c2"))
    wedges = x.join(y, F.col("lo") == F.col("lo2")).where("x <> y").select("lo", "x", "y")
    found = wedges.join(close, (F.col("x") == F.col("c1")) & (F.col("y") == F.col("c2")))
    counts = found.select(F.explode(F.array("lo", "x", "y")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("triangles"))
    return graph.nodes.select("id").join(counts, F.col("id") == F.col("at"), "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id, coefficient = 2 T / (k (k - 1)); 0 below two neighbours."""
    k = degrees(undirected(graph, type_)).select(F.col("id").alias("at"), "k")
    both = triangles(graph, type_).join(k, F.col("id") == F.col("at"), "left")
    return both.select("id", F.when(F.col("k") > 1, 2.0 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("coefficient"))


def pair_measures(graph: PropertyGraph, pairs: DataFrame, type_: str | None = None) -> DataFrame:
    """For pairs (x, y): common, total, preferential, adamic_adar, resource_allocation; over distinct neighbours."""
    edges = undirected(graph, type_)
    near = cut(adjacency(edges))
    k = cut(degrees(edges))
    asked = pairs.select("x", "y").distinct()
    first = asked.join(near, F.col("x") == F.col("near")).select("x", "y", F.col("far").alias("z"))
    second = near.select(F.col("near").alias("y2"), F.col("far").alias("z2"))
    common = first.join(second, (F.col("y") == F.col("y2")) & (F.col("z") == F.col("z2"))).join(k.select(F.col("id").alias("zk"), F.col("k").alias("kz")), F.col("z") == F.col("zk"))
    sums = common.groupBy("x", "y").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("kz") > 1, 1.0 / F.log("kz")).otherwise(0.0)).alias("aa"), F.sum(1.0 / F.col("kz")).alias("ra"))
    out = asked.join(sums, ["x", "y"], "left").join(k.select(F.col("id").alias("x"), F.col("k").alias("kx")), "x", "left").join(k.select(F.col("id").alias("y"), F.col("k").alias("ky")), "y", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("x", "y", zero("common").alias("common"), (zero("kx") + zero("ky") - zero("common")).alias("total"), (zero("kx") * zero("ky")).alias("preferential"), F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"), F.coalesce("ra", F.lit(0.0)).alias("resource_allocation"))


def nearest_neighbours(graph: PropertyGraph, k: int, type_: str | None = None, sources: DataFrame | None = None, label: str | None = None, zeros: bool = False) -> DataFrame:
    """id, other, score, rank: the k others of highest neighbour-set Jaccard (then least id) for each source.

    Others share a neighbour, or with `zeros` any other fills up ranks at 0, as a small candidate set may ask for.
    label: others have this label.
    """
    edges = undirected(graph, type_)
    near, d = cut(adjacency(edges)), cut(degrees(edges))
    start = graph.nodes.select("id") if sources is None else sources.select("id")
    cand = graph.nodes.select(F.col("id").alias("other")) if label is None else graph.nodes.where(F.array_contains("labels", label)).select(F.col("id").alias("other"))
    left = start.join(near, F.col("id") == F.col("near")).select("id", F.col("far").alias("z"))
    back = near.select(F.col("near").alias("other"), F.col("far").alias("z"))
    shared = left.join(back, "z").where("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("c"))
    sized = shared.join(d.select("id", F.col("k").alias("ki")), "id").join(d.select(F.col("id").alias("other"), F.col("k").alias("ko")), "other")
    scored = sized.join(cand, "other", "left_semi").select("id", "other", (F.col("c") / (F.col("ki") + F.col("ko") - F.col("c"))).alias("score"))
    if zeros:
        # a source short of k has under k scored others: of the 2 k least ids, k at least are neither scored nor itself
        least = cand.orderBy("other").limit(2 * k)
        rest = start.crossJoin(F.broadcast(least)).where("id <> other").join(scored.select("id", "other"), ["id", "other"], "left_anti").withColumn("score", F.lit(0.0))
        scored = scored.unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def minimum_spanning_forest(graph: PropertyGraph, weight: str, type_: str | None = None) -> DataFrame:
    """rel, near, far, weight: Boruvka rounds. Each component takes its lightest way out (ties: least id), then merges."""
    edges = cut(weighted(graph, weight, type_).where("near <> far"))
    label, chosen = cut(graph.nodes.select("id", F.col("id").alias("label"))), None
    while True:
        a, b = label.select(F.col("id").alias("near"), F.col("label").alias("la")), label.select(F.col("id").alias("far"), F.col("label").alias("lb"))
        cross = cut(edges.join(a, "near").join(b, "far").where("la <> lb"))
        if cross.isEmpty():
            break
        edges = cross.select("near", "far", "rel", "weight")
        way = cross.select(F.explode(F.array("la", "lb")).alias("c"), F.struct("weight", "rel", "near", "far", "la", "lb").alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        picked = cut(way.select("e.*").distinct())
        new = picked.select("rel", "near", "far", "weight")
        chosen = new if chosen is None else chosen.unionByName(new)
        merge = picked.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        roots = least_labels(label.select(F.col("label").alias("id")).distinct(), cut(adjacency(merge)))
        label = cut(label.join(roots.select(F.col("id").alias("label"), F.col("label").alias("root")), "label").select("id", F.col("root").alias("label")))
    return chosen if chosen is not None else edges.select("rel", "near", "far", "weight").limit(0)


def _collected(df: DataFrame) -> list:
    if df.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES:
        raise GraphError("LIMIT", f"more than {DRIVER_EDGES} edges")
    return df.collect()


def _lowlinks(graph: PropertyGraph, type_: str | None) -> tuple[set[int], set[int]]:
    """Articulation points and bridge relationship ids, by one depth-first search without recursion."""
    rels = graph.rels if type_ is None else graph.rels.where(F.col("type") == type_)
    adj = defaultdict(list)
    for r in _collected(rels.where("src <> dst").select("id", "src", "dst")):
        adj[r.src].append((r.dst, r.id))
        adj[r.dst].append((r.src, r.id))
    order, low, points, bridges = {}, {}, set(), set()
    for root in sorted(adj):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, None, iter(sorted(adj[root])))], 0
        while stack:
            v, by, rest = stack[-1]
            for w, e in rest:
                if e == by:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, e, iter(sorted(adj[w]))))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > order[u]:
                        bridges.add(by)
                    if u == root:
                        children += 1
                    elif low[v] >= order[u]:
                        points.add(u)
        if children > 1:
            points.add(root)
    return points, bridges


def articulation_points(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id of each node whose loss parts its component; on the driver, up to DRIVER_EDGES."""
    return graph.spark.createDataFrame([(x,) for x in sorted(_lowlinks(graph, type_)[0])], "id long")


def bridges(graph: PropertyGraph, type_: str | None = None) -> DataFrame:
    """id of each relationship whose loss parts its component; one of two parallel ones is none."""
    return graph.spark.createDataFrame([(x,) for x in sorted(_lowlinks(graph, type_)[1])], "id long")


def max_flow(graph: PropertyGraph, source: int, sink: int, capacity: str, type_: str | None = None) -> float:
    """Largest flow along directions; parallel capacities add up. Level graphs and blocking flows, on the driver."""
    graph.node(source), graph.node(sink)
    if source == sink:
        raise GraphError("INVALID_ARGUMENT", "source and sink are one")
    to, cap, adj = [], [], defaultdict(list)
    for r in _collected(weighted(graph, capacity, type_).groupBy("near", "far").agg(F.sum("weight").alias("c")).where("near <> far")):
        for a, b, c in ((r.near, r.far, r.c), (r.far, r.near, 0.0)):
            adj[a].append(len(to))
            to.append(b)
            cap.append(c)
    total = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for e in adj[v]:
                if cap[e] > 0 and to[e] not in level:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if sink not in level:
            return total
        at, path = {v: 0 for v in level}, []
        v = source
        while True:
            if v == sink:
                push = min(cap[e] for e in path)
                total += push
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                v, path = source, []
                continue
            while at[v] < len(adj[v]):
                e = adj[v][at[v]]
                if cap[e] > 0 and level.get(to[e]) == level[v] + 1:
                    break
                at[v] += 1
            else:
                if v == source:
                    break
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1
                continue
            path.append(e)
            v = to[e]
