"""Triples: source, type, target, as tab-separated or quoted comma-separated lines."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.runtime import cut, numbered

#: A quoted or a bare field of a CSV line.
_FIELD = r'("(?:[^"]|"")*"|[^",]*)'


@dataclass
class Imported:
    graph: PropertyGraph
    accepted: int
    duplicates: int


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value; CRLF and LF end lines."""
    text = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"))
    return numbered(text.withColumn("at", F.monotonically_increasing_id()), [F.col("at")], "line", 1).select("line", "value")


def bad_line(lines: DataFrame, good, what: str) -> None:
    first = lines.where(~good).orderBy("line").first()
    if first:
        raise GraphError("PARSE_ERROR", f"{what} line {first['line']}", line=first["line"], column=1)


def read_triples(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    lines = cut(lines_of(spark, path))
    if csv:
        shape = f"^{_FIELD},{_FIELD},{_FIELD}$"
        bad_line(lines, F.col("value").rlike(shape), "malformed CSV")
        raw = [F.regexp_extract("value", shape, k) for k in (1, 2, 3)]
        fields = [F.when(f.startswith('"'), F.regexp_replace(f.substr(F.lit(2), F.length(f) - 2), '""', '"')).otherwise(f) for f in raw]
    else:
        parts = F.split("value", "\t", -1)
        bad_line(lines, F.size(parts) == 3, "malformed triple")
        fields = [F.get(parts, F.lit(k)) for k in range(3)]
    out = lines.select("line", *[f.alias(n) for f, n in zip(fields, ("source", "type", "target"), strict=True)])
    bad_line(out, (F.length("source") > 0) & (F.length("type") > 0) & (F.length("target") > 0) & ~F.concat("source", "type", "target").rlike("[\t\n]"), "empty or unsafe field in")
    return out


def import_triples(graph: PropertyGraph, path: str, csv: bool = False, preserve_parallel: bool = False) -> Imported:
    """A new version with a node for each new entity; all or nothing."""
    triples = cut(read_triples(graph.spark, path, csv))
    total = triples.count()
    names = triples.select(F.col("source").alias("ext"), (F.col("line") * 2).alias("o")).union(triples.select(F.col("target").alias("ext"), (F.col("line") * 2 + 1).alias("o")))
    seen = names.groupBy("ext").agg(F.min("o").alias("o"))
    known = graph.nodes.where("ext is not null").select("ext", "id")
    fresh = seen.join(known.select("ext"), "ext", "left_anti")
    fresh = cut(numbered(fresh, [F.col("o")], "id", graph.next_node))
    n = fresh.count()
    new_nodes = fresh.select("id", F.array().cast("array<string>").alias("labels"), F.array().cast("array<string>").alias("nulls"), "ext")
    ids = known.unionByName(fresh.select("ext", "id"))
    linked = triples.join(ids.select(F.col("ext").alias("source"), F.col("id").alias("src")), "source").join(ids.select(F.col("ext").alias("target"), F.col("id").alias("dst")), "target")
    rels = linked.select("line", "src", "type", "dst")
    if not preserve_parallel:
        rels = rels.groupBy("src", "type", "dst").agg(F.min("line").alias("line")).join(graph.rels.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti")
    rels = cut(numbered(rels, [F.col("line")], "id", graph.next_rel))
    m = rels.count()
    made = rels.select("id", "src", "dst", "type", F.array().cast("array<string>").alias("nulls"))
    out = replace(graph, nodes=graph.nodes.unionByName(new_nodes, allowMissingColumns=True), rels=graph.rels.unionByName(made, allowMissingColumns=True), next_node=graph.next_node + n, next_rel=graph.next_rel + m)
    out.check_constraints()
    return Imported(out, m, total - m)


def triples_of(graph: PropertyGraph) -> DataFrame:
    """id, source, type, target in names (or ids where a node has none)."""
    name = F.coalesce("ext", F.col("id").cast("string"))
    ends = graph.nodes.select(F.col("id").alias("end"), name.alias("name"))
    a, b = ends.select(F.col("end").alias("src"), F.col("name").alias("source")), ends.select(F.col("end").alias("dst"), F.col("name").alias("target"))
    return graph.rels.select("id", "src", "dst", "type").join(a, "src").join(b, "dst").select("id", "source", "type", "target")


def export_triples(graph: PropertyGraph, path: str | None = None) -> str | None:
    """Write lines in the order of relationship ids to a folder, or return them as text for small graphs (None)."""
    lines = triples_of(graph).select("id", F.concat_ws("\t", "source", "type", "target").alias("value")).orderBy("id").select("value")
    if path is None:
        return "".join(r.value + "\n" for r in lines.toLocalIterator())
    lines.write.text(path)
    return None
