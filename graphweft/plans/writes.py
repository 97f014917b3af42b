"""Write clauses. Each evaluates its rows first, then makes a new version of the graph."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.errors import parse_error
from graphweft.graph import P, q
from graphweft.plans.compiler import Compiler, Frame, Var, sort_columns
from graphweft.plans.parser import NodePattern, Path, RelPattern
from graphweft.runtime import cut, numbered
from graphweft.values import spark_type


class Writer:
    """Applies writes of one statement; `compiler.graph` is the working version."""

    def __init__(self, compiler: Compiler):
        self.compiler, self.mutated = compiler, False

    @property
    def graph(self):
        return self.compiler.graph

    def _set_graph(self, graph) -> None:
        self.compiler.graph = graph

    def rebound(self, frame: Frame) -> Frame:
        """The frame with the entities' columns as they are now."""
        df = frame.df
        for var, v in frame.scope.items():
            if not v.is_entity:
                continue
            old = [c for c in frame.columns_of(var) if c != f"v_{var}_id"]
            df = df.drop(*old)
            if v.kind == "node":
                now = self.compiler.nodes(var, None)
            else:
                now = self.compiler.rels(var, None).drop(f"near_{var}", f"far_{var}")
            df = df.join(now.withColumnRenamed(f"v_{var}_id", "now_id"), q(f"v_{var}_id") == F.col("now_id"), "left").drop("now_id")
        return replace(frame, df=df)

    def steady(self, frame: Frame) -> Frame:
        return replace(frame, df=cut(frame.df))

    # CREATE
    def create(self, frame: Frame, paths: list[Path]) -> Frame:
        for path in paths:
            self.check_new(frame, path)
            frame = self.create_path(self.steady(frame), path)
        return self.compiler.tidy(frame)

    def check_new(self, frame: Frame, path: Path) -> None:
        for rel in path.rels:
            if rel.type is None or rel.length is not None or rel.direction == "both":
                raise parse_error("a new relationship has one type, one direction and one hop")
            if rel.var in frame.scope:
                raise parse_error(f"{rel.var} is bound already")
        for node in path.nodes:
            if node.var in frame.scope:
                if frame.scope[node.var].kind != "node":
                    raise parse_error(f"{node.var} is no node")
                if node.label is not None or node.props:
                    raise parse_error(f"{node.var} is bound already")
            elif not path.rels and node.label is None and not node.props and not node.anonymous:
                raise parse_error(f"unknown variable {node.var}")
        if path.var is not None:
            raise parse_error("a written path has no variable")

    def create_path(self, frame: Frame, path: Path) -> Frame:
        for node in path.nodes:
            if node.var not in frame.scope:
                frame = self.add(frame, "node", node)
            elif frame.df.where(q(f"v_{node.var}_id").isNull()).limit(1).count():
                raise parse_error(f"{node.var} is null")
        for k, rel in enumerate(path.rels):
            a, b = path.nodes[k].var, path.nodes[k + 1].var
            if rel.direction == "in":
                a, b = b, a
            frame = self.add(frame, "rel", rel, a, b)
        return frame

    def add(self, frame: Frame, kind: str, pattern: NodePattern | RelPattern, a: str = "", b: str = "") -> Frame:
        bind = self.compiler.binder(frame)
        values = {k: bind.bind(e) for k, e in pattern.props}
        graph = self.graph.widened(kind, {k: t for k, (_, t) in values.items()})
        first = graph.next_node if kind == "node" else graph.next_rel
        var = pattern.var
        rows = numbered(frame.df, sort_columns(frame.order), f"v_{var}_id", first)
        made = {P + k: graph.fitted(kind, k, c, t) for k, (c, t) in values.items()}
        nulls = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(k)) for k, (c, _) in values.items()])) if values else F.array().cast("array<string>")
        base = {"id": q(f"v_{var}_id"), "nulls": nulls.cast("array<string>")}
        if kind == "node":
            base |= {"labels": F.array(F.lit(pattern.label)) if pattern.label else F.array().cast("array<string>"), "ext": F.lit(None).cast("string")}
        else:
            base |= {"src": q(f"v_{a}_id"), "dst": q(f"v_{b}_id"), "type": F.lit(pattern.type)}
        old = graph.nodes if kind == "node" else graph.rels
        new = rows.select(*[(base | made).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields])
        n = rows.count()
        self.mutated |= n > 0
        both = old.unionByName(new)
        self._set_graph(replace(graph, nodes=both, next_node=first + n) if kind == "node" else replace(graph, rels=both, next_rel=first + n))
        return self.rebound(Frame(rows, frame.scope | {var: Var(kind)}, frame.order or ((f"v_{var}_id", True),)))

    # MERGE
    def merge(self, frame: Frame, paths: list[Path], on: dict[str, list]) -> Frame:
        for path in paths:
            frame = self.merge_path(frame, path, on)
        return frame

    def merge_path(self, frame: Frame, path: Path, on: dict[str, list]) -> Frame:
        """Match the whole pattern, else create it. Rows that ask for the same thing share what the first one creates."""
        for node in path.nodes:
            if node.var not in frame.scope and node.label is None and not node.props:
                raise parse_error("MERGE needs a label or a property for a new node")
        self.check_new(frame, Path(None, [n if n.var not in frame.scope else replace(n, label=None, props=[]) for n in path.nodes], path.rels))
        bind = self.compiler.binder(frame)
        asked, pattern = [], Path(None, [], [])
        columns: dict[str, tuple[Column, Any]] = {}

        def held(props: list) -> list:
            out = []
            for k, e in props:
                n = self.compiler.name("ask")
                columns[n] = bind.bind(e)
                out.append((k, ("var", n)))
            return out

        pattern.nodes = [n if n.var in frame.scope and not n.props else replace(n, props=held(n.props)) for n in path.nodes]
        pattern.rels = [replace(r, props=held(r.props)) for r in path.rels]
        scope = frame.scope | {n: Var("value", t) for n, (_, t) in columns.items()}
        df = frame.df.select("*", *[c.cast(spark_type(t)).alias(f"v_{n}") for n, (c, t) in columns.items()])
        frame = self.steady(Frame(df, scope, frame.order))
        for n in path.nodes:
            if n.var in frame.scope and frame.df.where(q(f"v_{n.var}_id").isNull()).limit(1).count():
                raise parse_error(f"{n.var} is null")
        asked = list(dict.fromkeys([*[frame.key(n.var) for n in path.nodes if n.var in frame.scope], *[f"v_{n}" for n in columns]]))
        known = {v: x for v, x in frame.scope.items() if frame.key(v) in asked}
        wanted = frame.df.select(*[q(c) for v in known for c in Frame(frame.df, known).columns_of(v)]).dropDuplicates(asked) if asked else frame.df.select(F.lit(1).alias("one")).limit(1)
        found = self.compiler.match(Frame(wanted, known), [pattern], None, False).df.select(*[q(a).alias(f"on_{a}") for a in asked]).distinct()
        first = {"node": self.graph.next_node, "rel": self.graph.next_rel}
        if asked:
            cond = None
            for a in asked:
                this = q(a).eqNullSafe(q(f"on_{a}"))
                cond = this if cond is None else cond & this
            missing = self._first_rows(frame, frame.df.join(found, cond, "left_anti"), asked)
        else:
            missing = frame.df.limit(1) if self.compiler.match(Frame(wanted, known), [pattern], None, False).df.isEmpty() else frame.df.limit(0)
        missing = cut(missing)
        if not missing.isEmpty():
            self.create_path(Frame(missing, frame.scope, frame.order), pattern)
        new = [x for x in [*path.nodes, *path.rels] if x.var not in frame.scope]
        frame = self.rebound(frame)
        out = self.compiler.match(frame, [Path(path.var, pattern.nodes, pattern.rels)], None, False)
        out = Frame(out.df, {v: x for v, x in out.scope.items() if v not in columns}, out.order)
        named = [x for x in new if not x.anonymous]
        if (on["create"] or on["match"]) and new:
            if not named:
                raise parse_error("ON needs a variable of the pattern")
            out = self.steady(out)
            probe = named[0]
            kind = "rel" if isinstance(probe, RelPattern) else "node"
            ident = q(f"v_{probe.var}_id")
            order = sort_columns(frame.order) or [F.lit(1)]
            nth = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
            out = self.steady(replace(out, df=out.df.withColumn("is_new", (ident >= first[kind]) & (nth == 1))))
            rows = {"create": F.col("is_new"), "match": ~F.col("is_new")}
            for which in ("create", "match"):
                if on[which]:
                    out = self.set(out, on[which], rows[which])
            out = replace(out, df=out.df.drop("is_new"))
        return out

    @staticmethod
    def _first_rows(frame: Frame, df: DataFrame, keys: list[str]) -> DataFrame:
        """The first row of each key, in the frame's order."""
        order = sort_columns(frame.order) or [F.lit(1)]
        nth = F.row_number().over(Window.partitionBy(*[q(k) for k in keys]).orderBy(*order))
        return df.withColumn("nth", nth).where("nth = 1").drop("nth")

    # SET, REMOVE, DELETE
    def targets(self, frame: Frame, var: str, rows: Column | None) -> tuple[str, Frame]:
        if var not in frame.scope:
            raise parse_error(f"unknown variable {var}")
        if not frame.scope[var].is_entity:
            raise parse_error(f"{var} is no node or relationship")
        frame = frame if rows is None else replace(frame, df=frame.df.where(rows))
        if frame.df.where(q(f"v_{var}_id").isNull()).limit(1).count():
            raise parse_error(f"{var} is null")
        return frame.scope[var].kind, frame

    def set(self, frame: Frame, sets: list[tuple], rows: Column | None = None) -> Frame:
        for s in sets:  # all names and types before any job
            if s[1] not in frame.scope:
                raise parse_error(f"unknown variable {s[1]}")
            self.compiler.binder(frame).bind(s[-1])
        frame = self.steady(frame)
        for s in sets:
            kind, chosen = self.targets(frame, s[1], rows)
            bind = self.compiler.binder(frame)
            if s[0] == "key":
                values = {s[2]: bind.bind(s[3])}
            elif s[2][0] == "map":
                values = {k: bind.bind(e) for k, e in s[2][1]}
            else:
                c, t = bind.bind(s[2])
                if not (isinstance(t, tuple) and t[0] == "map"):
                    raise parse_error("SET needs a map")
                values = {k: (c.getField(k), u) for k, u in t[1].items()}
            self.update(kind, chosen, s[1], values, s[0])
            frame = self.rebound(frame)
        return frame

    def update(self, kind: str, frame: Frame, var: str, values: dict[str, tuple[Column, Any]], how: str) -> None:
        """how: key (null stays, as present), merge (null removes) or replace (all other keys go)."""
        graph = self.graph.widened(kind, {k: t for k, (_, t) in values.items() if t != "null" or how == "key"})
        have = graph.types(kind)
        values = {k: v for k, v in values.items() if k in have}
        stamp = F.struct(*[q(c) for c, _ in frame.order]) if frame.order else F.struct(F.lit(0))
        new = F.struct(*[graph.fitted(kind, k, c, t).alias(k) for k, (c, t) in values.items()]) if values else F.struct(F.lit(0).alias("none"))
        # the last row wins where rows meet at one entity
        changes = frame.df.select(q(f"v_{var}_id").alias("at"), stamp.alias("o"), new.alias("new")).groupBy("at").agg(F.max_by("new", "o").alias("new"))
        changes = cut(changes)
        if changes.isEmpty():
            return
        self.mutated |= bool(values) or how == "replace"
        df = graph.nodes if kind == "node" else graph.rels
        joined = df.join(changes, F.col("id") == F.col("at"), "left")
        here, out = F.col("at").isNotNull(), {}
        nulls = F.col("nulls")
        if how == "replace":
            nulls = F.when(here, F.array().cast("array<string>")).otherwise(nulls)
        for k in have:
            if k in values:
                out[P + k] = F.when(here, F.col("new").getField(k)).otherwise(q(P + k))
                nulls = F.when(here, F.array_remove(nulls, k)).otherwise(nulls)
                if how == "key":
                    nulls = F.when(here & F.col("new").getField(k).isNull(), F.array_append(nulls, F.lit(k))).otherwise(nulls)
            elif how == "replace":
                out[P + k] = F.when(~here, q(P + k))
        out["nulls"] = nulls
        df = cut(joined.select(*[out.get(c, q(c)).alias(c) for c in df.columns]))
        self._set_graph(replace(graph, **{"nodes" if kind == "node" else "rels": df}))

    def remove(self, frame: Frame, items: list[tuple]) -> Frame:
        for _, var, _ in items:
            if var not in frame.scope:
                raise parse_error(f"unknown variable {var}")
        frame = self.steady(frame)
        for what, var, name in items:
            kind, chosen = self.targets(frame, var, None)
            df = self.graph.nodes if kind == "node" else self.graph.rels
            ids = chosen.df.select(q(f"v_{var}_id").alias("at")).distinct()
            here = F.col("at").isNotNull()
            joined = df.join(ids, F.col("id") == F.col("at"), "left")
            if what == "label":
                if kind != "node":
                    raise parse_error(f"{var} has no labels")
                change = {"labels": F.when(here, F.array_remove("labels", name)).otherwise(F.col("labels"))}
            else:
                change = {"nulls": F.when(here, F.array_remove("nulls", name)).otherwise(F.col("nulls"))}
                if name in self.graph.types(kind):
                    change[P + name] = F.when(~here, q(P + name))
            new = cut(joined.select(*[change.get(c, q(c)).alias(c) for c in df.columns]))
            self.mutated |= not ids.isEmpty()
            self._set_graph(replace(self.graph, **{"nodes" if kind == "node" else "rels": new}))
            frame = self.rebound(frame)
        return frame

    def delete(self, frame: Frame, names: list[str]) -> Frame:
        for var in names:
            if var not in frame.scope:
                raise parse_error(f"unknown variable {var}")
        frame = self.steady(frame)
        for var in names:
            kind, chosen = self.targets(frame, var, None)
            ids = cut(chosen.df.select(q(f"v_{var}_id").alias("id")).distinct())
            self.mutated |= not ids.isEmpty()
            graph = self.graph.delete_nodes(ids) if kind == "node" else self.graph.delete_rels(ids)
            self._set_graph(graph.materialised())
        return frame
