"""Algorithms on a five-node graph with known results, and against brute force."""

import pytest
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.operators import centrality, components, embeddings, graphsage, paths, structure, vectors, walks


@pytest.fixture(scope="module")
def graph(spark):
    g = PropertyGraph.empty(spark).add_nodes([(["Person"], {})] * 3 + [([], {})] * 2)
    return g.add_rels([(1, "R", 2, {"weight": 5}), (2, "R", 3, {"weight": 2}), (3, "R", 1, {"weight": 10}), (3, "R", 4, {"weight": 1})]).materialised()


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_degree(graph):
    assert [column(centrality.degree(graph, "R", d), "degree") for d in ("out", "in", "both")] == [[1, 1, 2, 0, 0], [1, 1, 1, 1, 0], [2, 2, 3, 1, 0]]
    with pytest.raises(GraphError):
        centrality.degree(graph, "missing")


def test_pagerank(graph):
    ranks = column(centrality.pagerank(graph, "R", 0.85, 25), "rank")
    assert ranks == pytest.approx([0.197393, 0.244361, 0.284278, 0.197393, 0.076575], abs=1e-6)


def test_components(graph):
    assert column(components.weakly_connected(graph), "component") == [0, 0, 0, 0, 1]
    assert column(components.strongly_connected(graph), "component") == [0, 0, 0, 1, 2]
    assert column(components.label_propagation(graph), "label") == [1, 1, 1, 1, 5]


def test_structure(spark, graph):
    assert column(structure.triangles(graph), "triangles") == [1, 1, 1, 0, 0]
    assert column(structure.clustering(graph), "coefficient") == pytest.approx([1, 1, 1 / 3, 0, 0])
    assert column(structure.articulation_points(graph), "id") == [3]
    assert column(structure.bridges(graph), "id") == [4]
    assert structure.max_flow(graph, 1, 4, "weight") == 1
    forest = structure.minimum_spanning_forest(graph, "weight").agg(F.count("rel"), F.sum("weight")).first()
    assert tuple(forest) == (3, 8.0)
    r = structure.pair_measures(graph, spark.createDataFrame([(1, 3), (1, 2)], "x long, y long")).orderBy("y").collect()
    assert (r[1].common, r[1].total, r[1].preferential) == (1, 4, 6)
    assert r[0].adamic_adar == pytest.approx(0.9102, abs=1e-4) and r[0].resource_allocation == pytest.approx(1 / 3)
    near = structure.nearest_neighbours(graph, 2, sources=spark.createDataFrame([(1,)], "id long"), label="Person").orderBy("rank").collect()
    assert [(x.other, round(x.score, 3)) for x in near] == [(2, 0.333), (3, 0.25)]


@pytest.mark.parametrize("k", [1, 2, 3, 9])
def test_neighbours_of_no_likeness_fill_up(spark, k):
    g = PropertyGraph.empty(spark).add_nodes([([], {})] * 9)
    ends = [(1, 2), (1, 3), (4, 3), (5, 6), (7, 6), (7, 3), (8, 2)]
    g = g.add_rels([(a, "R", b, {}) for a, b in ends]).materialised()
    near = {n: {x for e in ends if n in e for x in e if x != n} for n in range(1, 10)}
    got = {}
    for x in structure.nearest_neighbours(g, k, zeros=True).orderBy("id", "rank").collect():
        got.setdefault(x.id, []).append((x.other, round(x.score, 6)))
    score = lambda a, b: round(len(near[a] & near[b]) / max(len(near[a] | near[b]), 1), 6)
    assert got == {n: sorted(((m, score(n, m)) for m in near if m != n), key=lambda x: (-x[1], x[0]))[:k] for n in near}


def test_paths(graph):
    assert paths.dijkstra(graph, 1, 3, "weight") == ([1, 2, 3], 7.0)
    assert paths.a_star(graph, 1, 3, "weight", lambda c: F.lit(0.0)) == ([1, 2, 3], 7.0)
    assert paths.bfs_path(graph, 1, 4) == [1, 2, 3, 4]
    with pytest.raises(GraphError) as e:
        paths.bfs_path(graph, 1, 5)
    assert e.value.status == "NOT_FOUND"
    assert [r.path for r in paths.simple_paths(graph, 1, 4, 4).collect()] == [[1, 2, 3, 4]]
    with pytest.raises(GraphError) as e:
        paths.topological_sort(graph)
    assert e.value.status == "EXISTS"


def test_walks(graph):
    assert walks.random_walk(graph, 1, 5, seed=3) == walks.random_walk(graph, 1, 5, seed=3)
    with pytest.raises(GraphError):
        walks.random_walk(graph, 99, 5)


def test_embeddings(graph):
    a, b = (embeddings.fastrp(graph, 4, seed=1).orderBy("id").collect() for _ in range(2))
    assert a == b and len(a) == 5


def test_graphsage(spark, graph):
    import numpy as np

    config = graphsage.Config(2, 2, 3, 1, True, 42)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.5, 0.5]), (5, [0.2, 0.8])]
    data = spark.createDataFrame([(i, x, [0.1, 0.2, 0.7]) for i, x in rows], "id long, features array<double>, targets array<double>")
    model = graphsage.Model.create(config)
    t = graphsage.train(graph, model, data, 1, 0.01, 2, 0.2, seed=9)
    assert (t.train_rows, t.validation_rows, t.batches) == (4, 1, 2) and t.train_loss >= 0
    with pytest.raises(GraphError):
        graphsage.train(graph, model, data.withColumn("targets", F.transform("targets", lambda x: x / 2)), loss="softmax")
    # gradients against finite differences
    r = np.random.default_rng(0)
    x, y, mean = r.random((5, 2)), r.random((5, 3)), np.eye(5)[[1, 0, 3, 2, 4]]
    z, kept = graphsage.forward(model, x, mean, False)
    grads = graphsage.backward(model, mean, kept, graphsage.loss_of(z, y, "mse")[1], False)
    for k in range(2):
        for w, g in ((model.own[k], grads[k][0]), (model.near[k], grads[k][1])):
            old = w[0, 0]
            w[0, 0] = old + 1e-6
            up = graphsage.loss_of(graphsage.forward(model, x, mean, False)[0], y, "mse")[0]
            w[0, 0] = old - 1e-6
            down = graphsage.loss_of(graphsage.forward(model, x, mean, False)[0], y, "mse")[0]
            w[0, 0] = old
            assert abs((up - down) / 2e-6 - g[0, 0]) < 1e-5


def test_graphsage_neighbours():
    """The links multiply as the dense matrix does, rows without any included."""
    import numpy as np

    near, far = np.array([0, 0, 3, 2, 3, 3]), np.array([1, 2, 0, 4, 1, 2])
    dense = np.zeros((5, 5))
    dense[near, far] = 1
    dense /= np.maximum(dense.sum(1, keepdims=True), 1)
    links, h = graphsage.Neighbours(5, near, far), np.random.default_rng(2).random((5, 3))
    assert np.allclose(links @ h, dense @ h) and np.allclose(links.T @ h, dense.T @ h)
    none = graphsage.Neighbours(5, near[:0], far[:0])
    assert not (none @ h).any() and not (none.T @ h).any()


@pytest.mark.parametrize("iterations", [0, 1, 2, 9])
def test_pagerank_with_dangling_nodes(spark, iterations):
    """Against the plain iteration: parallel relationships, loops, a node alone, nodes without a way out."""
    import numpy as np

    n, pairs = 7, [(0, 1), (0, 1), (0, 2), (1, 3), (2, 2), (2, 5), (4, 0), (4, 3), (3, 5)]
    nodes = spark.createDataFrame([(i, []) for i in range(n)], "id long, labels array<string>")
    rels = spark.createDataFrame([(k, a, b, "T") for k, (a, b) in enumerate(pairs)], "id long, src long, dst long, type string")
    flow = np.zeros((n, n))
    for a, b in pairs:
        flow[b, a] += 1
    flow /= np.maximum(flow.sum(0), 1)
    dangling, want = flow.sum(0) == 0, np.full(n, 1 / n)
    for _ in range(iterations):
        want = 0.15 / n + 0.85 * (flow @ want + want[dangling].sum() / n)
    got = {r.id: r["rank"] for r in centrality.pagerank(PropertyGraph.of(nodes, rels), None, 0.85, iterations).collect()}
    assert len(got) == n and np.allclose([got[i] for i in range(n)], want) and abs(sum(got.values()) - 1) < 1e-9


def test_small_world_shards(spark):
    """Graphs of bounded size, several a task, find what one finds when each is searched as wide as it is long."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(90)]
    base = spark.createDataFrame(rows, "id long, vector array<double>")
    index = vectors.HnswIndex(base, 8, 60, partitions=2, shard_bytes=20 * 6 * 8)
    sizes = [len(x.ids) // 8 for x in index.graphs.select("ids").collect()]
    assert sum(sizes) == 90 and max(sizes) == 20 and len(sizes) >= 5
    asked = base.where("id % 30 = 0")
    exact = {(x.query, x.id) for x in vectors.cosine_search_all(base, asked, 4).collect()}
    assert {(x.query, x.id) for x in index.search_all(asked, 4, 20).collect()} == exact


def test_vectors(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(60)]
    base = spark.createDataFrame(rows, "id long, vector array<double>")
    query = rows[7][1]
    v = np.array([x for _, x in rows])
    cos = v @ np.array(query) / np.linalg.norm(v, axis=1) / np.linalg.norm(query)
    best = np.argsort(-cos)[:5].tolist()
    assert [x.id for x in vectors.cosine_search(base, query, 5).collect()] == best
    assert [x.id for x in vectors.SignatureIndex(base, 8).search(query, 5, 60).collect()] == best
    found = [x.id for x in vectors.HnswIndex(base, 8, 40).search(query, 5, 40).collect()]
    assert len(set(found) & set(best)) >= 4


def test_recall_on_the_tables(spark, tmp_path):
    """Every index against the exact search, for all queries with an id divisible by 50; and saved indexes answer alike."""
    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector").cache()
    asked = base.where("id % 50 = 0")
    exact = {(r.query, r.id) for r in vectors.cosine_search_all(base, asked, 10).collect()}
    signature = vectors.SignatureIndex(base, len(base.first().vector), seed=3)
    graph = vectors.HnswIndex(base, 16, 100)
    flat = vectors.HnswIndex(base, 16, 100, flat=True)
    found = {"signature": signature.search_all(asked, 10), "graph": graph.search_all(asked, 10, 100), "flat": flat.search_all(asked, 10, 100, 8)}
    recall = {name: len({(r.query, r.id) for r in df.collect()} & exact) / len(exact) for name, df in found.items()}
    assert min(recall.values()) >= 0.9, recall
    one = [float(x) for x in base.where("id = 50").first().vector]
    for k, (index, search) in enumerate(((signature, lambda x: x.search(one, 5, 200)), (graph, lambda x: x.search(one, 5, 100)), (flat, lambda x: x.search(one, 5, 100, 8)))):
        index.save(f"file://{tmp_path}/{k}")
        back = type(index).load(spark, f"file://{tmp_path}/{k}")
        assert [r.id for r in search(back).collect()] == [r.id for r in search(index).collect()]
