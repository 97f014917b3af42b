"""Property graphs as DataFrames. A graph is immutable: each write makes a new version."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.errors import GraphError
from graphweft.runtime import cut
from graphweft.values import as_json, literal, literal_type, spark_type, to_json, type_of, unify

#: Before a property's key in column names.
P = "p_"
NODE_BASE = {"id": "bigint", "labels": "array<string>", "nulls": "array<string>", "ext": "string"}
REL_BASE = {"id": "bigint", "src": "bigint", "dst": "bigint", "type": "string", "nulls": "array<string>"}
INT64_MAX = 2**63 - 1


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def _empty(spark: SparkSession, base: dict) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(k, T._parse_datatype_string(t)) for k, t in base.items()]))


@dataclass(frozen=True)
class Shape:
    """What is known of a graph made from tables, while its frames are these.

    ends: the labels at both ends of each type. owned: for types whose relationships lie in the rows of one of their
    nodes, which end that is, and a frame of both (the node's columns begin with own_).
    """

    nodes: DataFrame
    rels: DataFrame
    ends: dict[str, tuple[str, str]]
    owned: dict[str, tuple[str, DataFrame]]


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, labels, nulls (keys present as null), ext (external id), p_<key>...; rels: id, src, dst, type, nulls, p_<key>...

    A key is one column of its own type; a key with several types is canonical JSON, and listed in `mixed`.
    """

    nodes: DataFrame
    rels: DataFrame
    next_node: int = 1
    next_rel: int = 1
    mixed: frozenset = frozenset()  # ("node" or "rel", key)
    constraints: tuple = ()  # ("require" or "unique", label or None, key)
    indexes: tuple = ()  # (label or None, key)
    shape: Shape | None = None

    @property
    def known_shape(self) -> Shape | None:
        """None once a write has changed the graph."""
        s = self.shape
        return s if s is not None and s.nodes is self.nodes and s.rels is self.rels else None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> PropertyGraph:
        return PropertyGraph(_empty(spark, NODE_BASE), _empty(spark, REL_BASE))

    @staticmethod
    def of(nodes: DataFrame, rels: DataFrame, **options) -> PropertyGraph:
        """A graph of given frames; missing base columns are added. next ids are found unless given."""
        for base, name in ((NODE_BASE, "nodes"), (REL_BASE, "rels")):
            df = nodes if name == "nodes" else rels
            for k, t in base.items():
                if k not in df.columns:
                    df = df.withColumn(k, F.lit(None).cast(t) if k == "ext" else F.array().cast(t))
            nodes, rels = (df, rels) if name == "nodes" else (nodes, df)
        return PropertyGraph(nodes, rels, **options)

    # schema
    def types(self, kind: str) -> dict[str, Any]:
        df = self.nodes if kind == "node" else self.rels
        return {f.name[len(P) :]: "json" if (kind, f.name[len(P) :]) in self.mixed else type_of(f.dataType) for f in df.schema.fields if f.name.startswith(P)}

    def widened(self, kind: str, wanted: dict[str, Any]) -> PropertyGraph:
        """This graph with a column for each wanted key, able to hold the wanted type."""
        df, mixed, have = (self.nodes if kind == "node" else self.rels), set(self.mixed), self.types(kind)
        for key, t in wanted.items():
            if t == "null" and key in have:
                continue
            if isinstance(t, tuple) and t[0] == "map" or t == ("list", "json"):
                t = "json"
            if key not in have:
                df = df.withColumn(P + key, F.lit(None).cast(spark_type(t)))
                if t == "json":
                    mixed.add((kind, key))
            elif have[key] != t and have[key] != "json":
                both = unify(have[key], t) if "int" not in (have[key], t) else None  # 1 and 1.0 stay apart
                if both != have[key]:
                    df = df.withColumn(P + key, as_json(q(P + key), have[key]))
                    mixed.add((kind, key))
        return replace(self, **{"nodes" if kind == "node" else "rels": df, "mixed": frozenset(mixed)})

    def fitted(self, kind: str, key: str, c: Column, t: Any) -> Column:
        """A value of type t as this graph stores the key."""
        have = self.types(kind)[key]
        return as_json(c, t) if have == "json" and t != "json" else c.cast(spark_type(have))

    # reading
    def node_count(self) -> int:
        return self.nodes.count()

    def rel_count(self) -> int:
        return self.rels.count()

    def symbols(self) -> DataFrame:
        """Distinct texts of labels, types and property keys (the hidden external id counts as a key)."""
        keyed = [self.nodes.select(F.explode("labels").alias("text")), self.rels.select(F.col("type").alias("text"))]
        for kind, df in (("node", self.nodes), ("rel", self.rels)):
            for k in self.types(kind):
                keyed.append(df.where(q(P + k).isNotNull() | F.array_contains("nulls", k)).select(F.lit(k).alias("text")).limit(1))
        keyed.append(self.nodes.where("ext is not null").select(F.lit("external id").alias("text")).limit(1))
        out = keyed[0]
        for k in keyed[1:]:
            out = out.union(k)
        return out.distinct()

    def stats(self) -> dict[str, int]:
        return {"nodes": self.node_count(), "relationships": self.rel_count(), "symbols": self.symbols().count()}

    def find_nodes(self, label: str | None, key: str, value: Any) -> DataFrame:
        """Exact typed match; doubles by their bits, so -0.0 is not 0.0 and a NaN is itself."""
        types = self.types("node")
        if key not in types:
            return self.nodes.where("false")
        df = self.nodes if label is None else self.nodes.where(F.array_contains("labels", label))
        c, t = q(P + key), literal_type(value)
        if t == "null":
            return df.where(c.isNull() & F.array_contains("nulls", key))
        if types[key] == "json":
            return df.where(c == as_json(*literal(value)))
        if t != types[key]:
            return df.where("false")
        if t == "double":
            return df.where(_bits(c) == struct.pack(">d", value).hex())
        return df.where(c == literal(value)[0])

    def node(self, ident: int) -> dict:
        return self._get(self.nodes, ident, "node")

    def relationship(self, ident: int) -> dict:
        return self._get(self.rels, ident, "relationship")

    def _get(self, df: DataFrame, ident: int, what: str) -> dict:
        row = df.where(F.col("id") == ident).first()
        if row is None:
            raise GraphError("NOT_FOUND", f"no {what} {ident}")
        return row.asDict(recursive=True)

    def node_property(self, ident: int, key: str) -> Any:
        """The value; None for one present as null; NOT_FOUND where absent."""
        row = self.node(ident)
        if row.get(P + key) is None and key not in (row["nulls"] or ()):
            raise GraphError("NOT_FOUND", f"node {ident} has no {key}")
        return row.get(P + key)

    def has_label(self, ident: int, label: str) -> bool:
        return label in self.node(ident)["labels"]

    def relationships_of(self, ident: int, direction: str = "out", type_: str | None = None) -> DataFrame:
        """direction: out, in or both. A self-loop comes once."""
        df = self.rels if type_ is None else self.rels.where(F.col("type") == type_)
        if direction == "both":
            return df.where((F.col("src") == ident) | (F.col("dst") == ident))
        return df.where(F.col("src" if direction == "out" else "dst") == ident)

    # single writes, batched by the caller where there are many
    def add_nodes(self, rows: Iterable[tuple[list[str], dict]]) -> PropertyGraph:
        rows = list(rows)
        return self._added("node", [({"labels": list(dict.fromkeys(labels))}, props) for labels, props in rows])

    def add_rels(self, rows: Iterable[tuple[int, str, int, dict]]) -> PropertyGraph:
        return self._added("rel", [({"src": s, "type": t, "dst": d}, props) for s, t, d, props in rows])

    def _added(self, kind: str, rows: list[tuple[dict, dict]]) -> PropertyGraph:
        if not rows:
            return self
        wanted: dict[str, Any] = {}
        for _, props in rows:
            for k, v in props.items():
                t, have = literal_type(v), wanted.get(k, "null")
                wanted[k] = have if t == "null" else t if have in ("null", t) else "json"
        wide = self.widened(kind, wanted)
        first = self.next_node if kind == "node" else self.next_rel
        df, types = (wide.nodes if kind == "node" else wide.rels), wide.types(kind)
        data = []
        for n, (base, props) in enumerate(rows):
            row = dict.fromkeys(df.columns) | base | {"id": first + n, "nulls": [k for k, v in props.items() if v is None]}
            row |= {P + k: to_json(v) if types[k] == "json" else v for k, v in props.items()}
            data.append(tuple(row[c] for c in df.columns))
        new = self.spark.createDataFrame(data, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))
        both = df.unionByName(new)
        return replace(wide, **({"nodes": both, "next_node": first + len(rows)} if kind == "node" else {"rels": both, "next_rel": first + len(rows)}))

    def set_property(self, kind: str, ident: int, key: str, value: Any) -> PropertyGraph:
        """Set one key (None: present as null)."""
        (self.node if kind == "node" else self.relationship)(ident)
        c, t = literal(value)
        wide = self.widened(kind, {key: t})
        df, here = (wide.nodes if kind == "node" else wide.rels), F.col("id") == ident
        rest = F.array_remove("nulls", key)
        df = df.withColumns({P + key: F.when(here, wide.fitted(kind, key, c, t)).otherwise(q(P + key)), "nulls": F.when(here, F.array_append(rest, F.lit(key)) if value is None else rest).otherwise(F.col("nulls"))})
        return replace(wide, **{"nodes" if kind == "node" else "rels": df})

    def unset_property(self, kind: str, ident: int, key: str) -> PropertyGraph:
        (self.node if kind == "node" else self.relationship)(ident)
        if key not in self.types(kind):
            return self
        df, here = (self.nodes if kind == "node" else self.rels), F.col("id") == ident
        df = df.withColumns({P + key: F.when(~here, q(P + key)), "nulls": F.when(here, F.array_remove("nulls", key)).otherwise(F.col("nulls"))})
        return replace(self, **{"nodes" if kind == "node" else "rels": df})

    def add_label(self, ident: int, label: str) -> PropertyGraph:
        self.node(ident)
        new = F.when(F.col("id") == ident, F.array_distinct(F.array_append("labels", F.lit(label)))).otherwise(F.col("labels"))
        return replace(self, nodes=self.nodes.withColumn("labels", new))

    def remove_label(self, ident: int, label: str) -> PropertyGraph:
        self.node(ident)
        return replace(self, nodes=self.nodes.withColumn("labels", F.when(F.col("id") == ident, F.array_remove("labels", label)).otherwise(F.col("labels"))))

    def delete_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without the nodes of `ids` (column id) and their relationships."""
        gone = ids.select(F.col("id").alias("gone")).distinct()
        nodes = self.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti")
        rels = self.rels.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
        return replace(self, nodes=nodes, rels=rels)

    def delete_rels(self, ids: DataFrame) -> PropertyGraph:
        gone = ids.select(F.col("id").alias("gone")).distinct()
        return replace(self, rels=self.rels.join(gone, F.col("id") == F.col("gone"), "left_anti"))

    def materialised(self) -> PropertyGraph:
        return replace(self, nodes=cut(self.nodes), rels=cut(self.rels))

    # checks
    def problems(self) -> DataFrame:
        """problem, id: bad ids, repeated ids, dangling ends and broken constraints."""
        def named(df: DataFrame, name: str) -> DataFrame:
            return df.select(F.lit(name).alias("problem"), F.col("id").cast("long").alias("id"))

        found = []
        for df, kind, next_id in ((self.nodes, "node", self.next_node), (self.rels, "relationship", self.next_rel)):
            found.append(named(df.where(f"id is null or id < 1 or id >= {next_id}"), f"{kind} id"))
            found.append(named(df.groupBy("id").count().where("count > 1"), f"repeated {kind}"))
        ends = self.nodes.select(F.col("id").alias("end"))
        for side in ("src", "dst"):
            found.append(named(self.rels.join(ends, F.col(side) == F.col("end"), "left_anti"), f"dangling {side}"))
        for kind, label, key in self.constraints:
            bad = self.violations(kind, label, key)
            found.append(named(bad.select(F.col("first").alias("id")), kind))
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    def validate(self) -> None:
        bad = self.problems().orderBy("problem", "id").first()
        if bad:
            status = {"require": "NOT_FOUND", "unique": "EXISTS"}.get(bad.problem, "CORRUPT")
            raise GraphError(status, f"{bad.problem}: {bad.id}", id=bad.id)

    def violations(self, kind: str, label: str | None, key: str) -> DataFrame:
        """first, second: the offending node (require), or a pair that shares a value (unique; nulls are free)."""
        df = self.nodes if label is None else self.nodes.where(F.array_contains("labels", label))
        c = q(P + key) if key in self.types("node") else F.lit(None).cast("string")
        if kind == "require":
            return df.where(c.isNull()).select(F.col("id").alias("first"), F.lit(None).cast("long").alias("second"))
        groups = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        shared = groups.where("n > 1").select(F.col("value").alias("shared"), "first")
        later = df.join(shared, c == F.col("shared")).where("id > first")
        return later.groupBy("first").agg(F.min("id").alias("second"))

    def check_constraints(self) -> None:
        for kind, label, key in self.constraints:
            bad = self.violations(kind, label, key).orderBy("first").first()
            if bad:
                raise GraphError("NOT_FOUND" if kind == "require" else "EXISTS", f"{kind} {label or '*'}.{key}: node {bad['first']}", first=bad["first"], second=bad["second"])

    # metadata
    def create_constraint(self, kind: str, label: str | None, key: str) -> PropertyGraph:
        if kind not in ("require", "unique"):
            raise GraphError("INVALID_ARGUMENT", f"unknown constraint {kind}")
        if (kind, label, key) in self.constraints:
            raise GraphError("EXISTS", f"{kind} {label}.{key}")
        out = replace(self, constraints=(*self.constraints, (kind, label, key)))
        out.check_constraints()
        return out

    def drop_constraint(self, kind: str, label: str | None, key: str) -> PropertyGraph:
        if (kind, label, key) not in self.constraints:
            raise GraphError("NOT_FOUND", f"{kind} {label}.{key}")
        return replace(self, constraints=tuple(c for c in self.constraints if c != (kind, label, key)))

    def create_index(self, label: str | None, key: str) -> PropertyGraph:
        if (label, key) in self.indexes:
            raise GraphError("EXISTS", f"index {label}.{key}")
        return replace(self, indexes=(*self.indexes, (label, key)))

    def drop_index(self, label: str | None, key: str) -> PropertyGraph:
        if (label, key) not in self.indexes:
            raise GraphError("NOT_FOUND", f"index {label}.{key}")
        return replace(self, indexes=tuple(i for i in self.indexes if i != (label, key)))

    def build_index(self, label: str | None, key: str) -> NodeIndex:
        return NodeIndex(self, label, key)


def _bits(c: Column) -> Column:
    """The 64 bits of a double as hexadecimal text: Arrow batches, since Spark's own equality folds zeros and NaNs."""

    @F.pandas_udf("string")
    def bits(v: pd.Series) -> pd.Series:
        return v.map(lambda x: struct.pack(">d", x).hex())

    return F.when(c.isNotNull(), bits(c))


class NodeIndex:
    """Ids of nodes by an exact property value, from a snapshot hash-partitioned and sorted by the value."""

    def __init__(self, graph: PropertyGraph, label: str | None, key: str):
        df = graph.nodes if label is None else graph.nodes.where(F.array_contains("labels", label))
        if key not in graph.types("node"):
            raise GraphError("NOT_FOUND", f"no property {key}")
        self.rows = cut(df.where(q(P + key).isNotNull()).select(q(P + key).alias("value"), "id").repartition("value").sortWithinPartitions("value", "id"))

    def find(self, value: Any) -> DataFrame:
        return self.rows.where(F.col("value") == literal(value)[0]).select("id")

    def lookup(self, values: DataFrame, column: str) -> DataFrame:
        """Many lookups at once: an equi-join."""
        return values.join(self.rows, values[column] == self.rows.value).drop("value")
