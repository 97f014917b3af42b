"""Property-graph files: node and relationship lines with typed values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.errors import GraphError
from graphweft.graph import P, PropertyGraph, q
from graphweft.runtime import cut, numbered
from graphweft.sources.triples import Imported, bad_line, lines_of
from graphweft.values import CODE_PATTERN, as_json, encode, spark_type

#: First letter of a code -> type.
KINDS = {"b": "bool", "i": "int", "d": "double", "s": "string", "x": "bytes"}


def valid_code(c: Column) -> Column:
    whole = F.when(c.startswith("i:"), c.substr(F.lit(3), F.length(c)).try_cast("bigint").isNotNull()).otherwise(F.lit(True))
    return c.rlike(CODE_PATTERN) & whole


def decoded(c: Column, kind: str) -> Column:
    """The value of a valid code as a column of that type."""
    rest = c.substr(F.lit(3), F.length(c))
    if kind == "bool":
        return rest == "1"
    if kind == "int":
        return rest.cast("bigint")
    if kind == "string":
        return F.decode(F.unhex(rest), "UTF-8")
    if kind == "bytes":
        return F.unhex(rest)
    return hex_double(rest)


def hex_double(bits: Column) -> Column:
    """A double from its 16 hexadecimal digits, in Spark's own arithmetic."""
    high, low = F.conv(F.substring(bits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(bits, 9, 8), 16, 10).cast("long")
    sign = F.when(high >= 2**31, -1.0).otherwise(1.0)
    power = F.shiftright(high, 20).bitwiseAND(F.lit(2047))
    part = high.bitwiseAND(F.lit(2**20 - 1)).cast("double") * float(2**32) + low.cast("double")
    normal = (1.0 + part / float(2**52)) * F.pow(F.lit(2.0), (power - 1023).cast("double"))
    tiny = part / float(2**52) * F.pow(F.lit(2.0), F.lit(-1022.0))
    odd = F.when(part == 0.0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(power == 2047, odd).when(power == 0, tiny).otherwise(normal)


def _entries(props: Column) -> Column:
    """array of (k, v) of a key=code;key=code field."""
    return F.when(props == "", F.array().cast("array<struct<k:string,v:string>>")).otherwise(
        F.transform(F.split(props, ";", -1), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, x.substr(F.instr(x, "=") + 1, F.length(x))).alias("v")))
    )


def _parsed(graph: PropertyGraph, path: str, kind: str, width: int) -> DataFrame:
    lines = cut(lines_of(graph.spark, path))
    parts = F.split("value", "\t", -1)
    bad_line(lines, (F.size(parts) == width) & (F.get(parts, F.lit(0)) == kind), f"malformed {kind}")
    out = lines.select("line", *[F.get(parts, F.lit(k)).alias(f"f{k}") for k in range(1, width)])
    out = cut(out.withColumn("entries", _entries(F.col(f"f{width - 1}"))))
    good = F.forall("entries", lambda x: (F.length(x["k"]) > 0) & F.coalesce(valid_code(x["v"]), F.lit(False)))
    bad_line(out, good, f"malformed {kind} property,")
    return out


def _columns(entries: DataFrame, types: dict[str, str]) -> list[Column]:
    """A column for each key from the map column `map` of codes."""
    out = []
    for key, t in types.items():
        code = F.col("map")[key]
        if t == "json":
            value = F.lit(None).cast("string")
            for letter, kind in KINDS.items():
                value = F.when(code.startswith(letter + ":"), as_json(decoded(code, kind), kind)).otherwise(value)
        else:
            value = F.when(code.isNotNull() & (code != "n"), decoded(code, t)).cast(spark_type(t))
        out.append(value.alias(P + key))
    return out


def _types(graph: PropertyGraph, kind: str, entries: DataFrame) -> dict[str, str]:
    """Type of each key in the file: its one type, or json where there are several."""
    found: dict[str, set] = {}
    for r in entries.select(F.explode("entries").alias("e")).select("e.k", F.substring("e.v", 1, 1).alias("t")).distinct().collect():
        found.setdefault(r.k, set()).add(KINDS.get(r.t))
    out = {}
    for k, kinds in found.items():
        kinds.discard(None)
        out[k] = "null" if not kinds else kinds.pop() if len(kinds) == 1 else "json"
    return out


def import_property_graph(graph: PropertyGraph, node_path: str, rel_path: str, preserve_parallel: bool = False) -> Imported:
    """A new version; a repeated external id updates one node, labels are united, later values win. All or nothing."""
    nodes, rels = _parsed(graph, node_path, "node", 4), _parsed(graph, rel_path, "relationship", 6)
    bad_line(nodes, F.length("f1") > 0, "a node without an id,")
    labels = F.when(F.col("f2") == "", F.array().cast("array<string>")).otherwise(F.split("f2", ",", -1))
    bad_line(nodes, ~F.exists(labels, lambda x: x == ""), "empty label,")
    bad_line(rels, (F.length("f2") > 0) & (F.length("f3") > 0) & (F.length("f4") > 0), "empty field in relationship")

    types, rel_types = _types(graph, "node", nodes), _types(graph, "rel", rels)
    wide = graph.widened("node", types).widened("rel", rel_types)
    have, rel_have = wide.types("node"), wide.types("rel")

    stamped = nodes.select("line", F.col("f1").alias("ext"), labels.alias("labels"), "entries")
    merged = stamped.groupBy("ext").agg(
        F.min("line").alias("line"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "labels"))), lambda x: x["labels"]))).alias("new_labels"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "entries"))), lambda x: x["entries"])).alias("all"),
    )
    last = F.aggregate("all", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    merged = cut(merged.select("ext", "line", "new_labels", last.alias("map")))
    keyed = {k: have[k] for k in types}
    old = wide.nodes.where("ext is not null")
    fresh = merged.join(old.select("ext"), "ext", "left_anti")
    fresh = cut(numbered(fresh, [F.col("line")], "id", wide.next_node))
    n = fresh.count()
    nulls = F.map_keys(F.map_filter("map", lambda _, v: v == "n"))
    made = fresh.select("id", F.col("new_labels").alias("labels"), nulls.alias("nulls"), "ext", *_columns(fresh, keyed))
    changes = merged.select(F.col("ext").alias("c_ext"), "new_labels", "map", nulls.alias("new_nulls"), *[c.alias(f"c_{k}") for c, k in zip(_columns(merged, keyed), keyed, strict=True)])
    joined = wide.nodes.join(changes, F.col("ext") == F.col("c_ext"), "left")
    here = F.col("c_ext").isNotNull()
    new = {"labels": F.when(here, F.array_distinct(F.concat("labels", "new_labels"))).otherwise(F.col("labels"))}
    new["nulls"] = F.when(here, F.array_distinct(F.concat(F.array_except("nulls", F.map_keys("map")), "new_nulls"))).otherwise(F.col("nulls"))
    for k in keyed:
        new[P + k] = F.when(here & F.map_contains_key("map", F.lit(k)), q(f"c_{k}")).otherwise(q(P + k))
    updated = joined.select(*[new.get(c, q(c)).alias(c) for c in wide.nodes.columns])
    all_nodes = cut(updated.unionByName(made, allowMissingColumns=True))

    ids = all_nodes.where("ext is not null").select("ext", "id")
    ends = rels.select("line", F.col("f2").alias("a"), F.col("f3").alias("type"), F.col("f4").alias("b"), "entries")
    linked = ends.join(ids.select(F.col("ext").alias("a"), F.col("id").alias("src")), "a", "left").join(ids.select(F.col("ext").alias("b"), F.col("id").alias("dst")), "b", "left")
    linked = cut(linked.withColumn("map", F.aggregate("entries", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))))
    bad_line(linked, F.col("src").isNotNull() & F.col("dst").isNotNull(), "an unknown end in relationship")
    if not preserve_parallel:
        linked = linked.groupBy("src", "type", "dst").agg(F.min_by("map", "line").alias("map"), F.min("line").alias("line")).join(wide.rels.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti")
    linked = cut(numbered(linked, [F.col("line")], "id", wide.next_rel))
    m = linked.count()
    made_rels = linked.select("id", "src", "dst", "type", nulls.alias("nulls"), *_columns(linked, {k: rel_have[k] for k in rel_types}))
    out = replace(wide, nodes=all_nodes, rels=cut(wide.rels.unionByName(made_rels, allowMissingColumns=True)), next_node=wide.next_node + n, next_rel=wide.next_rel + m)
    out.check_constraints()
    return Imported(out, merged.count() + m, nodes.count() + rels.count() - merged.count() - m)


def _coded(graph: PropertyGraph, kind: str) -> Column:
    """key=code;... of a row, keys in order, present nulls included."""
    types = graph.types(kind)
    row = T.StringType()

    @F.udf(row)
    def code(values, nulls):  # noqa: ANN001, ANN202
        import json

        out = []
        for k in sorted(types):
            v = values[P + k]
            if v is not None:
                v = json.loads(v) if types[k] == "json" else v
                if isinstance(v, (list, dict)):
                    raise GraphError("INVALID_ARGUMENT", f"{k} holds a list or map, which the format has not")
                out.append(f"{k}={encode(v)}")
            elif k in (nulls or ()):
                out.append(f"{k}=n")
        return ";".join(out)

    return code(F.struct(*[q(P + k) for k in types]) if types else F.struct(F.lit(0).alias("none")), F.col("nulls"))


def property_lines(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(id, value) lines of nodes and of relationships."""
    name = F.coalesce("ext", F.concat(F.lit("n"), F.col("id").cast("string")))
    nodes = graph.nodes.select("id", F.concat_ws("\t", F.lit("node"), name, F.array_join(F.array_sort("labels"), ","), _coded(graph, "node")).alias("value"))
    ends = graph.nodes.select(F.col("id").alias("end"), name.alias("name"))
    rels = graph.rels.join(ends.select(F.col("end").alias("src"), F.col("name").alias("a")), "src").join(ends.select(F.col("end").alias("dst"), F.col("name").alias("b")), "dst")
    rels = rels.select("id", F.concat_ws("\t", F.lit("relationship"), F.concat(F.lit("r"), F.col("id").cast("string")), "a", "type", "b", _coded(graph, "rel")).alias("value"))
    return nodes, rels


def export_property_graph(graph: PropertyGraph, node_path: str, rel_path: str) -> None:
    """Deterministic folders of lines, sorted by ids; an export that is there already is not overwritten."""
    from graphweft.sources.snapshot import exists

    for path in (node_path, rel_path):
        if exists(graph.spark, path):
            raise GraphError("EXISTS", path)
    for lines, path in zip(property_lines(graph), (node_path, rel_path), strict=True):
        lines.orderBy("id").select("value").write.text(path)
