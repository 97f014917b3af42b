"""Cosine search: exact, by random-projection signatures with exact rerank, over a flat neighbour graph, and HNSW."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.runtime import cut

#: Bytes of query vectors that one broadcast block holds.
QUERY_BYTES = 8 << 20
#: Share of all rows that a search by signatures reranks.
SIGNATURE_SHARE = 0.5
#: Bytes of vectors that one small-world graph holds; a task with more rows makes several.
SHARD_BYTES = 64 << 20


def normalised(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, vector at unit length; null vectors are INVALID_ARGUMENT, zero ones stay."""
    if vectors.where(F.col(vector_col).isNull()).limit(1).count():
        raise GraphError("INVALID_ARGUMENT", "null vectors")
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select(F.col(id_col).alias("id"), F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v).alias("vector"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_search(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, score: the k best (then least id), in Spark's own functions; one pass, a top-k in each task."""
    if k < 1:
        raise GraphError("INVALID_ARGUMENT", "k")
    norm = float(np.linalg.norm(query)) or 1.0
    unit = F.array(*[F.lit(float(x) / norm) for x in query])
    return normalised(vectors).select("id", dot("vector", unit).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def query_blocks(queries: DataFrame, most: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set in blocks of bounded size."""
    ids, rows, size = [], [], 0
    for r in normalised(queries).toLocalIterator():
        ids.append(r["id"])
        rows.append(r["vector"])
        size += 8 * len(r["vector"])
        if size >= most:
            yield np.array(ids), np.array(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows)


def cosine_search_all(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank for each query (id, vector): matrix products in Arrow batches, a top-k for each batch,
    then one for each query. A query does not find the row of its own id."""
    base, out = normalised(vectors), None
    spark = vectors.sparkSession
    for qids, q in query_blocks(queries):
        sent = spark.sparkContext.broadcast((qids, q))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, rows = sent.value
            for b in batches:
                if not len(b):
                    continue
                ids = b["id"].to_numpy()
                scores = rows @ np.stack(b["vector"].to_numpy()).T
                scores[names[:, None] == ids[None]] = -np.inf
                n = min(k, len(ids))
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                s = np.take_along_axis(scores, top, 1)
                yield pd.DataFrame({"query": np.repeat(names, n), "id": ids[top].ravel(), "score": s.ravel()})

        part = base.mapInPandas(best, "query long, id long, score double").where("score > double('-infinity')")
        out = part if out is None else out.unionByName(cut(part))
    if out is None:
        out = base.select(F.lit(None).cast("long").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


class SignatureIndex:
    """Sign bits of random projections; the candidates nearest by Hamming distance are reranked exactly."""

    def __init__(self, vectors: DataFrame, dims: int, bits: int = 64, seed: int = 0):
        self.planes = np.random.default_rng(seed).standard_normal((min(bits, 64), dims))
        self.rows = cut(normalised(vectors).withColumn("signature", self._signature(F.col("vector"))))

    def _signature(self, v: Column) -> Column:
        out = F.lit(0).cast("long")
        for k, plane in enumerate(self.planes):
            bit = dot(v, F.array(*[F.lit(float(x)) for x in plane])) >= 0
            out = out.bitwiseOR(F.when(bit, F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    def search(self, query: list[float], k: int, candidates: int) -> DataFrame:
        """id, score; with as many candidates as rows this is the exact search."""
        unit = np.asarray(query, float) / (np.linalg.norm(query) or 1.0)
        own = sum(1 << i for i, plane in enumerate(self.planes) if plane @ unit >= 0)
        own = own - (1 << 64) if own >= 1 << 63 else own
        near = self.rows.withColumn("distance", F.bit_count(F.col("signature").bitwiseXOR(F.lit(own).cast("long")))).orderBy("distance", "id").limit(candidates)
        return near.select("id", dot("vector", F.array(*[F.lit(float(x)) for x in unit])).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def search_all(self, queries: DataFrame, k: int, share: float = SIGNATURE_SHARE) -> DataFrame:
        """query, id, score, rank of each query (id, vector), which is no match of its own; queries go in blocks of bounded size.

        Of each batch of rows the `share` nearest by Hamming distance (k + 1 at least) are reranked exactly, and k go on.
        """
        out, weights = None, np.uint64(1) << np.arange(len(self.planes), dtype=np.uint64)
        for ids, block in query_blocks(queries):
            signed = ((block @ self.planes.T >= 0) * weights).sum(1, dtype=np.uint64)

            def near(batches, ids=ids, block=block, signed=signed):  # noqa: ANN001, ANN202
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    own = batch.column(0).to_numpy(zero_copy_only=False)
                    rows = np.vstack(batch.column(1).to_numpy(zero_copy_only=False))
                    marks = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    for n, q_ in enumerate(ids):
                        far = np.bitwise_count(marks ^ signed[n]).astype(np.int64)
                        far[own == q_] = len(self_planes) + 1
                        kept = np.argsort(far, kind="stable")[: max(k + 1, int(share * len(own)))]
                        score = rows[kept] @ block[n]
                        best = np.lexsort((own[kept], -np.round(score, 12)))[: k + 1]
                        best = best[own[kept][best] != q_][:k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q_)), pa.array(own[kept][best]), pa.array(score[best])], ["query", "id", "score"])

            self_planes = self.planes
            found = self.rows.select("id", "vector", "signature").mapInArrow(near, "query long, id long, score double")
            found = cut(found)
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.rows.select(F.lit(None).cast("long").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)

    def search_exact(self, query: list[float], k: int) -> DataFrame:
        return cosine_search(self.rows.select("id", "vector"), query, k)

    def save(self, path: str) -> None:
        planes = self.rows.sparkSession.createDataFrame([(k, p.tolist()) for k, p in enumerate(self.planes)], "k int, plane array<double>")
        planes.write.parquet(f"{path}/planes")
        self.rows.write.parquet(f"{path}/rows")

    @staticmethod
    def load(spark, path: str) -> SignatureIndex:
        out = SignatureIndex.__new__(SignatureIndex)
        out.planes = np.array([r.plane for r in spark.read.parquet(f"{path}/planes").orderBy("k").collect()])
        out.rows = spark.read.parquet(f"{path}/rows")
        return out


class Hnsw:
    """One small-world graph over the rows of a task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = 8, construct: int = 64, seed: int = 0, flat: bool = False):
        self.ids, self.v, self.m, self.construct = ids, vectors, m, construct
        r = np.random.default_rng(seed)
        levels = np.zeros(len(ids), int) if flat else np.minimum((-np.log(np.maximum(r.random(len(ids)), 1e-12)) / np.log(max(m, 2))).astype(int), 16)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max()) + 1 if len(ids) else 0)]
        self.entry = -1
        for i, top in enumerate(levels.tolist()):
            self._add(i, top)

    def packed(self) -> tuple:
        """A row of HnswIndex.graphs: little-endian arrays; a level lists its nodes, how many links each has, and the links."""
        levels = []
        for links in self.links:
            parts = list(links), [len(x) for x in links.values()], [j for x in links.values() for j in x]
            levels.append(dict(zip(("nodes", "sizes", "links"), (np.array(x, "<i4").tobytes() for x in parts), strict=True)))
        return self.ids.astype("<i8").tobytes(), self.v.astype("<f8").tobytes(), self.entry, levels

    @staticmethod
    def unpacked(ids: bytes, vectors: bytes, entry: int, levels: list[dict]) -> Hnsw:
        out = Hnsw.__new__(Hnsw)
        out.ids = np.frombuffer(ids, "<i8")
        out.v, out.entry, out.top, out.links = np.frombuffer(vectors, "<f8").reshape(len(out.ids), -1), entry, len(levels) - 1, []
        for level in levels:
            nodes, sizes, links = (np.frombuffer(level[k], "<i4") for k in ("nodes", "sizes", "links"))
            ends = np.cumsum(sizes)
            links = links.tolist()
            out.links.append({n: links[e - s : e] for n, s, e in zip(nodes.tolist(), sizes.tolist(), ends.tolist(), strict=True)})
        return out

    def _near(self, q: np.ndarray, start: list[int], level: int, width: int) -> list[tuple[float, int]]:
        """Best-first search with a bounded result: (distance, row), nearest first."""
        seen = set(start)
        cand = [(1 - float(q @ self.v[i]), i) for i in start]
        heapq.heapify(cand)
        best = [(-d, i) for d, i in cand]
        heapq.heapify(best)
        while cand:
            d, i = heapq.heappop(cand)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [j for j in self.links[level].get(i, ()) if j not in seen]
            seen.update(fresh)
            if fresh:
                for dj, j in zip((1 - self.v[fresh] @ q).tolist(), fresh, strict=True):
                    if len(best) < width or dj < -best[0][0]:
                        heapq.heappush(cand, (dj, j))
                        heapq.heappush(best, (-dj, j))
                        if len(best) > width:
                            heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _add(self, i: int, top: int) -> None:
        if self.entry < 0:
            for level in range(top + 1):
                self.links[level][i] = []
            self.entry, self.top = i, top
            return
        at = [self.entry]
        for level in range(self.top, top, -1):
            at = [self._near(self.v[i], at, level, 1)[0][1]]
        for level in range(min(top, self.top), -1, -1):
            found = self._near(self.v[i], at, level, self.construct)
            most = self.m * 2 if level == 0 else self.m
            chosen = [j for _, j in found[: self.m]]
            self.links[level][i] = list(chosen)
            for j in chosen:
                row = self.links[level][j]
                row.append(i)
                if len(row) > most:
                    row.sort(key=lambda x: 1 - float(self.v[x] @ self.v[j]))
                    del row[most:]
            at = [j for _, j in found]
        for level in range(self.top + 1, top + 1):
            self.links[level][i] = []
        if top > self.top:
            self.entry, self.top = i, top

    def search(self, q: np.ndarray, k: int, width: int, entries: int = 1) -> list[tuple[int, float]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for level in range(self.top, 0, -1):
            at = [self._near(q, at, level, 1)[0][1]]
        if entries > 1:
            at = list(dict.fromkeys([*at, *np.linspace(0, len(self.ids) - 1, entries).astype(int).tolist()]))
        return [(int(self.ids[i]), 1 - d) for d, i in self._near(q, at, 0, max(k, width))[:k]]


class HnswIndex:
    """Small-world graphs of at most SHARD_BYTES of vectors, a row each; searches ask all and merge."""

    SCHEMA = "ids binary, vectors binary, entry int, levels array<struct<nodes:binary,sizes:binary,links:binary>>"

    def __init__(self, vectors: DataFrame, m: int = 8, construct: int = 64, partitions: int | None = None, seed: int = 0, flat: bool = False, shard_bytes: int = SHARD_BYTES):
        """partitions: tasks that build (the session's shuffle partitions unless given); a task makes as many graphs as its rows need."""
        rows = normalised(vectors)
        n = partitions or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        binary = pa.binary()
        kinds = [binary, binary, pa.int32(), pa.list_(pa.struct([("nodes", binary), ("sizes", binary), ("links", binary)]))]

        def made(ids: np.ndarray, rows_: np.ndarray) -> pa.RecordBatch:
            packed = Hnsw(ids, rows_, m, construct, seed, flat).packed()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(packed, kinds, strict=True)], ["ids", "vectors", "entry", "levels"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, held = np.zeros(0, np.int64), None
            for b in batches:
                if not b.num_rows:
                    continue
                more = np.vstack(b.column(1).to_numpy(zero_copy_only=False))
                ids, held = np.concatenate([ids, b.column(0).to_numpy()]), more if held is None else np.concatenate([held, more])
                most = max(1, shard_bytes // max(8 * held.shape[1], 1))
                while len(ids) >= most:
                    yield made(ids[:most], held[:most])
                    ids, held = ids[most:], held[most:]
            if len(ids):
                yield made(ids, held)

        # in order of ids, so that a repeated task makes the same graphs
        self.graphs = cut(rows.repartition(n, "id").sortWithinPartitions("id", "vector").mapInArrow(build, self.SCHEMA))

    def search_all(self, queries: DataFrame, k: int, width: int = 0, entries: int = 1) -> DataFrame:
        """query, id, score, rank; width 0 is a default from k. A query does not find the row of its own id."""
        width = width or max(4 * k, 32)
        out, spark = None, self.graphs.sparkSession
        for block in query_blocks(queries):
            sent = spark.sparkContext.broadcast(block)

            def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for row in range(b.num_rows):
                        graph = Hnsw.unpacked(*[b.column(c)[row].as_py() for c in ("ids", "vectors", "entry", "levels")])
                        found = [(int(i), j, s) for i, q in zip(*sent.value, strict=True) for j, s in graph.search(q, k + 1, width, entries) if j != i]
                        columns = list(zip(*found, strict=True)) if found else [[]] * 3
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "id", "score"])

            part = self.graphs.select("ids", "vectors", "entry", "levels").mapInArrow(best, "query long, id long, score double")
            out = part if out is None else out.unionByName(cut(part))
        if out is None:
            raise GraphError("INVALID_ARGUMENT", "no queries")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)

    def search(self, query: list[float], k: int, width: int = 0, entries: int = 1) -> DataFrame:
        one = self.graphs.sparkSession.createDataFrame([(-1, [float(x) for x in query])], "id long, vector array<double>")
        return self.search_all(one, k, width, entries).select("id", "score").orderBy(F.desc("score"), "id")

    def save(self, path: str) -> None:
        self.graphs.write.parquet(path)

    @staticmethod
    def load(spark, path: str) -> HnswIndex:
        out = HnswIndex.__new__(HnswIndex)
        out.graphs = spark.read.parquet(path)
        return out
