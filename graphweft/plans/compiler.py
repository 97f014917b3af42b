"""Clauses to DataFrames.

A frame is a lazy DataFrame with a scope. A variable is a group of columns: a node `a` has v_a_id, v_a_labels and
v_a_p_<key>; a value has v_a. Hidden columns keep the natural order of rows (ids in the order of binding), which
costs nothing until a query asks for ordered output, SKIP or LIMIT.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.errors import parse_error
from graphweft.functions.expressions import Binder, Typed
from graphweft.graph import P, PropertyGraph, q
from graphweft.plans.parser import AGGREGATES, Item, NodePattern, Path, Projection, RelPattern, has_aggregate, references
from graphweft.runtime import cut
from graphweft.values import as_json, literal, spark_type, unify


@dataclass(frozen=True)
class Var:
    kind: str  # node, rel, value, path
    type: Any = None
    nullable: bool = False  # an entity that an OPTIONAL MATCH may leave out

    @property
    def is_entity(self) -> bool:
        return self.kind in ("node", "rel")


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    scope: dict[str, Var] = field(default_factory=dict)
    order: tuple = ()  # (column name, ascending)
    halves: Halves | None = None

    def columns_of(self, var: str) -> list[str]:
        v = self.scope[var]
        if v.is_entity:
            head = f"v_{var}_"
            return [c for c in self.df.columns if c in (head + "id", head + "labels", head + "type", head + "src", head + "dst") or c.startswith(head + P)]
        return [f"v_{var}"]

    def key(self, var: str) -> str:
        return f"v_{var}_id" if self.scope[var].is_entity else f"v_{var}"

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*sort_columns(self.order)) if self.order else self.df


@dataclass(frozen=True)
class Halves:
    """How the rows of one MATCH came to be: those before it, joined by nodes that both know with those of its pattern."""

    whole: DataFrame  # holds only while it is the frame's
    left: Frame
    known: tuple[str, ...]
    paths: list[Path]
    where: tuple | None  # of the pattern alone


def falling(c: Column, t: T.DataType) -> Column:
    """What sorts upwards as a value that is not null sorts downwards."""
    if isinstance(t, T.BooleanType):
        return ~c
    if isinstance(t, T.IntegralType):
        return F.bitwise_not(c)
    if isinstance(t, T.FractionalType):
        return F.struct(~F.isnan(c), -c)
    if isinstance(t, T.ArrayType):
        # a list goes before those that it begins
        parts = F.transform(c, lambda x: F.struct(F.lit(0).alias("end"), *_rising(x, t.elementType, False)))
        return F.concat(parts, F.array(F.struct(F.lit(1).alias("end"), *[F.lit(None).alias(f"c{k}") for k in range(2)])))
    digits = "0123456789ABCDEF"
    text = c if isinstance(t, T.StringType) else F.to_json(c)
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), digits, digits[::-1]), F.lit("G"))


def _rising(c: Column, t: T.DataType, up: bool) -> list[Column]:
    """Two columns that sort upwards as one sorts in its own direction: nulls last ascending, first descending."""
    null = c.isNull()
    return [(null if up else ~null).alias("c0"), (c if up else falling(c, t)).alias("c1")]


def sort_columns(order: tuple) -> list[Column]:
    """Nulls last ascending, first descending."""
    return [q(c).asc_nulls_last() if up else q(c).desc_nulls_first() for c, up in order]


@dataclass(frozen=True)
class Aggregate:
    alias: str
    name: str
    distinct: bool
    value: Column | None  # none for count(*)
    names: frozenset  # variables of the value
    whole: Column  # over the rows themselves

    def function(self):
        if self.distinct:
            return {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda c: F.sum_distinct(c) / F.count_distinct(c)}[self.name]
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.name]

    def parts(self) -> list:
        """Aggregates of one side, from which joined() makes those of the join."""
        return [F.sum, F.count] if self.name == "avg" else [self.function()]

    def joined(self, weight: Column) -> Column:
        part = {f: q(f"{self.alias}_{f}") for f in ("count", "sum", "min", "max")}
        if self.name == "avg":
            return F.sum(part["sum"] * weight) / F.sum(part["count"] * weight)
        if self.name == "count":
            return F.coalesce(F.sum(part["count"] * weight), F.lit(0))
        return F.sum(part["sum"] * weight) if self.name == "sum" else self.function()(part[self.name])


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict | None = None, procedures: dict | None = None):
        self.graph, self.params, self.procedures = graph, params or {}, procedures or {}
        self.steps: list[str] = []
        self.fresh = 0
        self.dry = False  # only the steps are wanted: start no job
        self.labels: dict[str, set[str]] = {}  # what the shape of the graph tells of a node's label
        self.taken: str | None = None  # a relationship that came with its owner's scan

    def name(self, what: str = "o") -> str:
        self.fresh += 1
        return f"{what}_{self.fresh}"

    def start(self) -> Frame:
        return Frame(self.graph.spark.range(1).select(F.lit(0).alias("o_0")))

    def binder(self, frame: Frame) -> Binder:
        def lookup(name: str) -> Typed:
            if name not in frame.scope:
                raise parse_error(f"unknown variable {name}")
            v = frame.scope[name]
            return q(frame.key(name)), v.kind if v.kind != "value" else v.type

        def prop(name: str, key: str) -> Typed | None:
            v = frame.scope.get(name)
            if v is None:
                raise parse_error(f"unknown variable {name}")
            if not v.is_entity:
                return None
            if f"v_{name}_{P}{key}" in frame.df.columns:
                return q(f"v_{name}_{P}{key}"), self.graph.types(v.kind)[key]
            if key == "id":
                return q(f"v_{name}_id"), "int"
            return literal(None)

        return Binder(lookup, prop, self.params)

    # scans
    def nodes(self, var: str, label: str | None) -> DataFrame:
        df = self.graph.nodes if label is None else self.graph.nodes.where(F.array_contains("labels", label))
        return df.select(*[q(c).alias(f"v_{var}_{c}") for c in df.columns if c in ("id", "labels") or c.startswith(P)])

    def rels(self, var: str, type_: str | None, direction: str = "out", props: bool = True) -> DataFrame:
        """One row an orientation; near and far are the ends in the order of the pattern."""
        df = self.graph.rels if type_ is None else self.graph.rels.where(F.col("type") == type_)
        own = [q(c).alias(f"v_{var}_{c}") for c in df.columns if c in ("id", "type", "src", "dst") or (props and c.startswith(P))]
        out = df.select(*own, F.col("src").alias(f"near_{var}"), F.col("dst").alias(f"far_{var}"))
        back = df.select(*own, F.col("dst").alias(f"near_{var}"), F.col("src").alias(f"far_{var}"))
        if direction == "out":
            return out
        if direction == "in":
            return back
        return out.unionByName(back.where(F.col(f"near_{var}") != F.col(f"far_{var}")))

    def owned(self, rel: RelPattern, node: NodePattern, near: bool) -> DataFrame | None:
        """A relationship and the node that owns it (kept in the same row of a table) in one scan: no join of the two."""
        shape = self.graph.known_shape
        if shape is None or rel.type not in shape.owned or rel.length is not None or rel.direction == "both":
            return None
        end, wide = shape.owned[rel.type]
        if node.label not in (None, shape.ends[rel.type][0 if end == "src" else 1]) or (end == ("src" if rel.direction == "out" else "dst")) != near:
            return None
        ends = ("src", "dst") if rel.direction == "out" else ("dst", "src")
        rels = [q(c).alias(f"v_{rel.var}_{c}") for c in self.graph.rels.columns if c in ("id", "type", "src", "dst") or c.startswith(P)]
        nodes = [q(f"own_{c}").alias(f"v_{node.var}_{c}") for c in self.graph.nodes.columns if c in ("id", "labels") or c.startswith(P)]
        return wide.select(*rels, *nodes, *[q(c).alias(f"{side}_{rel.var}") for c, side in zip(ends, ("near", "far"), strict=True)])

    def steps_of(self, rel: RelPattern) -> set[tuple[str, str, str]] | None:
        """(type, label, label) that one hop may take, in its direction."""
        shape = self.graph.known_shape
        if shape is None:
            return None
        out = {(t, a, b) for t, (a, b) in shape.ends.items() if rel.type in (None, t)}
        back = {(t, b, a) for t, a, b in out}
        return out if rel.direction == "out" else back if rel.direction == "in" else out | back

    def hops(self, rel: RelPattern, near: str, target: set[str] | None) -> list[set[str]] | None:
        """Types that each hop of a walk may take: those that leave what it reached and can still end in time."""
        steps = self.steps_of(rel)
        if steps is None:
            return None
        high = rel.length[1]
        every = {x for _, a, b in steps for x in (a, b)}
        ends = [target & every if target else every]
        for _ in range(high):
            ends.append(ends[-1] | {a for _, a, b in steps if b in ends[-1]})
        here, out = self.labels.get(near) or every, []
        for k in range(1, high + 1):
            now = {(t, b) for t, a, b in steps if a in here and b in ends[high - k]}
            out.append({t for t, _ in now})
            here = {b for _, b in now}
        return out

    def has(self, df: DataFrame, frame: Frame, prefix: str, kind: str, props: list) -> Column | None:
        """Equality with each entry of a property map; the values may use the frame's variables."""
        cond = None
        bind = self.binder(frame)
        types = self.graph.types(kind)
        for key, e in props:
            c, t = bind.bind(e)
            if key in types:
                this = bind._compare("=", q(f"{prefix}{P}{key}"), types[key], c, t)
            else:
                this = F.lit(None).cast("boolean")
            cond = this if cond is None else cond & this
        return cond

    # patterns
    def pattern(self, frame: Frame, path: Path, used: list[Column]) -> Frame:
        """Expand a path. used: relationship ids (columns) that one MATCH has taken; none is taken twice."""
        frame = self.bind_node(frame, path.nodes[0], path.rels[0] if path.rels else None)
        hops: list[tuple[str, bool]] = []
        for rel, node, ahead in zip(path.rels, path.nodes[1:], [*path.rels, None][1:], strict=True):
            frame = self.expand(frame, self.here, rel, node, used, ahead)
            hops.append((self.hop, rel.length is not None))
        if path.var is not None:
            frame = self.bind_path(frame, path, hops)
        return frame

    def scan(self, node: NodePattern, ahead: RelPattern | None) -> DataFrame:
        """Rows of a new node, and of the relationship ahead where the node owns it."""
        wide = self.owned(ahead, node, True) if ahead is not None and ahead.var not in self.bound else None
        self.taken = ahead.var if wide is not None else None
        if wide is not None:
            return wide
        known = self.labels.get(node.var)
        return self.nodes(node.var, next(iter(known)) if node.label is None and known is not None and len(known) == 1 else node.label)

    def bind_node(self, frame: Frame, node: NodePattern, ahead: RelPattern | None = None) -> Frame:
        self.here, self.taken, self.bound = node.var, None, frame.scope
        if node.var not in frame.scope:
            self.labels.pop(node.var, None)
        if node.label is not None and self.graph.known_shape is not None:
            self.labels[node.var] = {node.label}
        self.steps.append(f"NodeScan({node.label or '*'})" if node.var not in frame.scope else f"Bound({node.var})")
        if node.var in frame.scope:
            if frame.scope[node.var].kind != "node":
                raise parse_error(f"{node.var} is no node")
            df = frame.df.where(q(f"v_{node.var}_id").isNotNull())
            if node.label is not None:
                df = df.where(F.array_contains(q(f"v_{node.var}_labels"), node.label))
            cond = self.has(df, frame, f"v_{node.var}_", "node", node.props)
            return replace(frame, df=df if cond is None else df.where(cond))
        scope = frame.scope | {node.var: Var("node")}
        alone = not frame.scope and not frame.order
        if alone and node.anonymous and node.label is None and not node.props and ahead is not None and ahead.length is None and ahead.direction != "both":
            # ends always exist: begin with the relationships
            rels, self.taken = self.rels(ahead.var, ahead.type, ahead.direction), ahead.var
            return Frame(rels.withColumn(f"v_{node.var}_id", q(f"near_{ahead.var}")), scope, ((f"v_{node.var}_id", True),))
        scan = self.scan(node, ahead)
        cond = self.has(scan, frame, f"v_{node.var}_", "node", node.props)
        if alone and cond is not None:
            scan = scan.where(cond)
        df = scan if alone else frame.df.crossJoin(scan) if cond is None else frame.df.join(scan, cond)
        return Frame(df, scope, (*frame.order, (f"v_{node.var}_id", True)))

    def expand(self, frame: Frame, near: str, rel: RelPattern, node: NodePattern, used: list[Column], ahead: RelPattern | None = None) -> Frame:
        if rel.var in frame.scope:
            raise parse_error(f"{rel.var} is bound already")
        self.steps.append(f"{'VarExpand' if rel.length else 'Expand'}({rel.type or '*'}, {rel.direction})")
        wide = self.owned(rel, node, False) if node.var not in frame.scope and self.taken != rel.var else None
        if node.var not in frame.scope:
            self.labels.pop(node.var, None)
        if node.label is not None and self.graph.known_shape is not None:
            self.labels[node.var] = {node.label}
        frame = self.expand_long(frame, near, rel, node, used) if rel.length else self.expand_one(frame, near, rel, used, wide)
        far = q(f"far_{rel.var}")
        self.bound, self.taken = frame.scope, None
        self.hop = rel.var
        self.here = node.var
        if node.var in frame.scope:
            if frame.scope[node.var].kind != "node":
                raise parse_error(f"{node.var} is no node")
            df = frame.df.where(far == q(f"v_{node.var}_id"))
            frame = replace(frame, df=df if node.label is None else df.where(F.array_contains(q(f"v_{node.var}_labels"), node.label)))
            cond = self.has(frame.df, frame, f"v_{node.var}_", "node", node.props)
            frame = frame if cond is None else replace(frame, df=frame.df.where(cond))
        elif wide is not None:
            more = self.has(wide, frame, f"v_{node.var}_", "node", node.props)
            frame = Frame(frame.df if more is None else frame.df.where(more), frame.scope | {node.var: Var("node")}, frame.order)
        elif node.anonymous and node.label is None and not node.props:
            # ends always exist: no join
            frame = Frame(frame.df.withColumn(f"v_{node.var}_id", far), frame.scope | {node.var: Var("node")}, frame.order)
        else:
            scan = self.scan(node, ahead)
            cond = far == q(f"v_{node.var}_id")
            more = self.has(scan, frame, f"v_{node.var}_", "node", node.props)
            df = frame.df.join(scan, cond if more is None else cond & more)
            frame = Frame(df, frame.scope | {node.var: Var("node")}, frame.order)
        return replace(frame, order=(*frame.order, (f"v_{node.var}_id", True)))

    def expand_one(self, frame: Frame, near: str, rel: RelPattern, used: list[Column], wide: DataFrame | None) -> Frame:
        steps = self.steps_of(rel)
        if steps is not None:
            here = self.labels.get(near)
            steps = {x for x in steps if here is None or x[1] in here}
            self.labels.setdefault(self.far_of[rel.var], {b for _, _, b in steps})
        taken = self.taken == rel.var
        rels = frame.df if taken else wide if wide is not None else self.rels(rel.var, rel.type, rel.direction)
        if steps is not None and rel.type is None and not taken:
            rels = rels.where(q(f"v_{rel.var}_type").isin(*sorted({t for t, _, _ in steps})))
        more = self.has(rels, frame, f"v_{rel.var}_", "rel", rel.props)
        if taken:
            df = rels if more is None else rels.where(more)
        else:
            cond = q(f"v_{near}_id") == q(f"near_{rel.var}")
            df = frame.df.join(rels, cond if more is None else cond & more)
        own = q(f"v_{rel.var}_id")
        for ids, many in used:
            df = df.where(~F.array_contains(ids, own) if many else ids != own)
        used.append((own, False))
        return Frame(df, frame.scope | {rel.var: Var("rel")}, (*frame.order, (f"v_{rel.var}_id", True)))

    def expand_long(self, frame: Frame, near: str, rel: RelPattern, node: NodePattern, used: list[Column]) -> Frame:
        """Unrolled joins, one a hop; shorter walks come first, and no walk takes a relationship twice.

        Walks of over two hops are written hop by hop, so that no hop is computed again by the next.
        """
        rels = self.rels(rel.var, rel.type, rel.direction)
        cond = self.has(rels, frame, f"v_{rel.var}_", "rel", rel.props)
        free = not rel.props or not any(references(e) for _, e in rel.props)
        if cond is not None and free:
            rels, cond = rels.where(cond), None
        step = rels.select(q(f"near_{rel.var}").alias("step_near"), q(f"far_{rel.var}").alias("step_far"), q(f"v_{rel.var}_id").alias("step_id"), q(f"v_{rel.var}_type").alias("step_type"), *([q(c) for c in rels.columns if c.startswith(f"v_{rel.var}_{P}")] if cond is not None else []))
        ids, seen, far = f"walk_{rel.var}", f"seen_{rel.var}", f"far_{rel.var}"
        level = frame.df.withColumns({ids: F.array().cast("array<bigint>"), seen: F.array().cast("array<bigint>"), far: q(f"v_{near}_id")})
        low, high = rel.length
        out, types = None, self.hops(rel, near, self.labels.get(node.var))
        for depth in range(1, high + 1):
            on = (q(far) == F.col("step_near")) & ~F.array_contains(q(ids), F.col("step_id"))
            here = step if types is None else step.where(F.col("step_type").isin(*sorted(types[depth - 1])))
            joined = level.join(here, on if cond is None else on & cond)
            for other, many in used:
                joined = joined.where(~F.array_contains(other, F.col("step_id")) if many else other != F.col("step_id"))
            level = joined.select(*[q(c) for c in frame.df.columns], F.array_append(q(ids), F.col("step_id")).alias(ids), F.array_append(q(seen), F.col("step_far")).alias(seen), F.col("step_far").alias(far))
            ended = types is not None and not types[depth - 1]
            if high > 2 and not self.dry and not ended:
                level = cut(level)
                ended = level.isEmpty()
            if depth >= low:
                out = level if out is None else out.unionByName(level)
            if ended:
                break
        out = level.where("false") if out is None else out
        used.append((q(ids), True))
        length = self.name()
        out = out.withColumn(length, F.size(q(ids)))
        return Frame(out, frame.scope, (*frame.order, (length, True), (ids, True)))

    def bind_path(self, frame: Frame, path: Path, hops: list[tuple[str, bool]]) -> Frame:
        nodes, rels = F.array(q(f"v_{path.nodes[0].var}_id")), F.array().cast("array<bigint>")
        for (var, long), node in zip(hops, path.nodes[1:], strict=True):
            nodes = F.concat(nodes, q(f"seen_{var}")) if long else F.array_append(nodes, q(f"v_{node.var}_id"))
            rels = F.concat(rels, q(f"walk_{var}")) if long else F.array_append(rels, q(f"v_{var}_id"))
        df = frame.df.withColumn(f"v_{path.var}", F.struct(nodes.alias("nodes"), rels.alias("relationships")))
        return Frame(df, frame.scope | {path.var: Var("path", "path")}, frame.order)

    # clauses
    def match(self, frame: Frame, paths: list[Path], where: tuple | None, optional: bool) -> Frame:
        if optional:
            return self.optional(frame, paths, where)
        before, used = frame, []
        for path in paths:
            self.far_of = {r.var: n.var for r, n in zip(path.rels, path.nodes[1:], strict=True)}
            frame = self.pattern(frame, path, used)
        if where is not None:
            frame = replace(frame, df=frame.df.where(self.binder(frame).condition(where)))
        out = self.tidy(frame)
        return replace(out, halves=self.split(before, paths, where, out.df))

    def split(self, left: Frame, paths: list[Path], where: tuple | None, whole: DataFrame) -> Halves | None:
        """The halves of a MATCH whose pattern needs nothing of the rows before it but some nodes' ids."""
        known = tuple(dict.fromkeys(n.var for p in paths for n in p.nodes if n.var in left.scope))
        given = {v for p in paths for x in [*p.nodes, *p.rels] for _, e in x.props for v in references(e)}
        if not known or given & set(left.scope) or any(p.var or any(r.length for r in p.rels) for p in paths):
            return None
        if where is not None and references(where) <= set(left.scope):
            left, where = replace(left, df=left.df.where(self.binder(left).condition(where))), None
        if where is not None and references(where) & set(left.scope):
            return None
        return Halves(whole, left, known, paths, where)

    def tidy(self, frame: Frame) -> Frame:
        """Only named variables and what orders the rows."""
        scope = {k: v for k, v in frame.scope.items() if not k.startswith("~")}
        keep = [c for v in scope for c in frame.columns_of(v)]
        keep += [c for c, _ in frame.order if c not in keep]
        return Frame(frame.df.select(*[q(c) for c in dict.fromkeys(keep)]) if keep else frame.df, scope, frame.order)

    def optional(self, frame: Frame, paths: list[Path], where: tuple | None) -> Frame:
        """The pattern once for each distinct set of bound values it depends on, then a left join."""
        used = {n.var for p in paths for n in p.nodes} | {v for p in paths for x in [*p.nodes, *p.rels] for _, e in x.props for v in references(e)}
        used |= references(where) if where is not None else set()
        known = [v for v in frame.scope if v in used]
        columns = [c for v in known for c in frame.columns_of(v)]
        keys = [frame.key(v) for v in known]
        if known:
            rest = [c for c in columns if c not in keys]
            base = frame.df.select(*[q(c) for c in columns]).groupBy(*[q(k) for k in keys]).agg(*[F.first(q(c)).alias(c) for c in rest]) if rest else frame.df.select(*[q(k) for k in keys]).distinct()
        else:
            base = self.start().df
        inner = self.match(Frame(base, {v: frame.scope[v] for v in known}), paths, where, False)
        new = {v: replace(x, nullable=True) for v, x in inner.scope.items() if v not in frame.scope}
        added = [c for v in new for c in inner.columns_of(v)]
        added += [c for c, _ in inner.order if c not in added and c not in columns]
        right = inner.df.select(*[q(k).alias(f"on_{k}") for k in keys], *[q(c) for c in dict.fromkeys(added)])
        if keys:
            cond = None
            for k in keys:
                this = q(k).eqNullSafe(q(f"on_{k}"))
                cond = this if cond is None else cond & this
            df = frame.df.join(right, cond, "left").drop(*[f"on_{k}" for k in keys])
        else:
            df = frame.df.join(right, F.lit(True), "left")
        order = [o for o in inner.order if o[0] not in columns]
        self.steps.append("Optional")
        return Frame(df, frame.scope | new, (*frame.order, *order))

    def unwind(self, frame: Frame, expr: tuple, var: str) -> Frame:
        c, t = self.binder(frame).bind(expr)
        if t == "null":
            c, t = F.array().cast("array<string>"), ("list", "null")
        if not (isinstance(t, tuple) and t[0] == "list"):
            raise parse_error("UNWIND needs a list")
        pos = self.name()
        old = [x for x in frame.df.columns if x != f"v_{var}"]
        df = frame.df.select(*[q(x) for x in old], F.posexplode(c).alias(pos, f"v_{var}"))
        self.steps.append("Unwind")
        return Frame(df, frame.scope | {var: Var("value", t[1])}, (*frame.order, (pos, True)))

    def call(self, frame: Frame, name: str, args: list, fields: list[tuple[str, str]]) -> Frame:
        if name not in self.procedures:
            raise parse_error(f"unknown procedure {name}")
        bind = self.binder(frame)
        bound = [bind.bind(a) for a in args]
        pos = self.name()
        made = self.procedures[name](self, frame, bound, args, pos)
        types, scope, out = made["types"], dict(frame.scope), made["df"]
        self.labels.clear()
        for f, alias in fields:
            if f not in types:
                raise parse_error(f"{name} yields no {f}")
            kind = types[f]
            if kind == "node":
                out = out.join(self.nodes(alias, None), q(f"y_{f}") == q(f"v_{alias}_id"), "left")
                scope[alias] = Var("node", nullable=True)
            else:
                out = out.withColumn(f"v_{alias}", q(f"y_{f}"))
                scope[alias] = Var("value", kind)
        self.steps.append(f"Call({name})")
        return self.tidy(Frame(out, scope, (*frame.order, (pos, True))))

    # projections
    def project(self, frame: Frame, p: Projection) -> tuple[Frame, list[tuple[str, Any]]]:
        """The projected frame, and for RETURN the result columns with their types."""
        seen = set()
        self.labels.clear()
        for item in p.items:
            if not p.last and not item.aliased and item.expr[0] != "var":
                raise parse_error(f"{item.name} needs AS")
            if item.name in seen:
                raise parse_error(f"{item.name} comes twice")
            seen.add(item.name)
        grouped = any(has_aggregate(i.expr) for i in p.items)
        source = frame
        frame, columns = self.grouped(frame, p) if grouped else self.plain(frame, p)
        self.steps.append("Aggregate" if grouped else "Project")
        if p.distinct and not grouped:
            frame = self.distinct(frame, p, columns)
            self.steps.append("Distinct")
        if p.order:
            frame = self.ordered(frame, source, p, columns, hidden=p.last and not grouped and not p.distinct)
            self.steps.append("Sort")
        frame = self.limited(frame, p)
        if p.where is not None:
            frame = replace(frame, df=frame.df.where(self.binder(frame).condition(p.where)))
            self.steps.append("Filter")
        return frame, columns

    def plain(self, frame: Frame, p: Projection) -> tuple[Frame, list]:
        bind, scope, out, columns = self.binder(frame), {}, [], []
        for item in p.items:
            c, t = bind.bind(item.expr)
            self._put(frame, item, c, t, scope, out, columns)
        keep = [q(x).alias(x) for x, _ in frame.order]
        renamed, order = [], []
        for (x, up), c in zip(frame.order, keep, strict=True):
            h = self.name()
            renamed.append(q(x).alias(h))
            order.append((h, up))
        if p.last and not p.distinct and p.order:
            # ORDER BY of a RETURN may also use what it does not return
            renamed += [q(x).alias(f"s_{x}") for v in frame.scope for x in frame.columns_of(v)]
        return Frame(frame.df.select(*out, *renamed), scope, tuple(order)), columns

    def _put(self, frame: Frame, item: Item, c: Column, t: Any, scope: dict, out: list, columns: list) -> None:
        if item.expr[0] == "var" and frame.scope[item.expr[1]].is_entity:
            var = frame.scope[item.expr[1]]
            scope[item.name] = var
            for old in frame.columns_of(item.expr[1]):
                out.append(q(old).alias(f"v_{item.name}_" + old[len(f"v_{item.expr[1]}_") :]))
            columns.append((item.name, var.kind))
            return
        scope[item.name] = Var("path" if t == "path" else "value", t)
        out.append(c.alias(f"v_{item.name}"))
        columns.append((item.name, t))

    def _stamp(self, frame: Frame) -> Column:
        """What sorts upwards as the rows do."""
        types = {f.name: f.dataType for f in frame.df.schema.fields} if frame.order else {}
        return F.struct(*[F.struct(*_rising(q(c), types[c], up)) for c, up in frame.order]) if frame.order else F.struct(F.lit(0))

    def grouped(self, frame: Frame, p: Projection) -> tuple[Frame, list]:
        bind = self.binder(frame)
        self.sure = {v for v, x in frame.scope.items() if x.is_entity and not x.nullable}
        keys, firsts, made, scope, columns, final = [], [], [], {}, [], []
        stamp = self._stamp(frame)
        for item in p.items:
            e = item.expr
            if not has_aggregate(e):
                c, t = bind.bind(e)
                if e[0] == "var" and frame.scope[e[1]].is_entity:
                    var = frame.scope[e[1]]
                    for old in frame.columns_of(e[1]):
                        new = f"v_{item.name}_" + old[len(f"v_{e[1]}_") :]
                        (keys if old == frame.key(e[1]) else firsts).append((new, q(old)))
                        final.append(q(new))
                    scope[item.name] = var
                    columns.append((item.name, var.kind))
                    continue
                keys.append((f"v_{item.name}", c))
            else:
                c, t = self.aggregate(bind, e, stamp, made)
                final.append(c.alias(f"v_{item.name}"))
                scope[item.name] = Var("value", t)
                columns.append((item.name, t))
                continue
            final.append(q(f"v_{item.name}"))
            scope[item.name] = Var("path" if t == "path" else "value", t)
            columns.append((item.name, t))
        h = self.name()
        df = self.factored(frame, p, keys, firsts, made, h)
        if df is None:
            df = frame.df.groupBy(*[c.alias(n) for n, c in keys]).agg(F.min(stamp).alias(h), *[F.first(c).alias(n) for n, c in firsts], *[m.whole.alias(m.alias) for m in made])
        return Frame(df.select(*final, q(h)), scope, ((h, True),)), columns

    def factored(self, frame: Frame, p: Projection, keys: list, firsts: list, made: list[Aggregate], h: str) -> DataFrame | None:
        """Aggregates of two halves that meet at shared nodes, without the rows of their join.

        Where a node has m rows on one side and n on the other, the join has m * n. Groups that depend on the shared
        nodes alone, and aggregates of one side each, need only one row a shared node from each side: sums and counts
        are weighted by the other side's number of rows, and distinct values are counted on their own side.
        """
        halves = frame.halves
        if halves is None or halves.whole is not frame.df:
            return None
        mine = set(halves.left.scope)
        grouping = [references(i.expr) for i in p.items if not has_aggregate(i.expr)]
        if any(not g <= set(halves.known) for g in grouping) or any(m.name == "collect" or (m.distinct and m.name == "avg") or (m.names & mine and m.names - mine) for m in made):
            return None
        steps, self.steps = self.steps, []
        meets = {v: f"half {k}" for k, v in enumerate(halves.known)}
        alone = [Path(None, [replace(n, var=meets.get(n.var, n.var), anonymous=n.anonymous or n.var in meets) for n in x.nodes], x.rels) for x in halves.paths]
        left, right = halves.left, self.match(Frame(self.start().df), alone, halves.where, False)
        self.steps = steps
        sides = ((left, [m for m in made if m.names <= mine and m.value is not None], [left.key(v) for v in halves.known]), (right, [m for m in made if m.names - mine], [right.key(x) for x in meets.values()]))
        at = [f"at_{k}" for k in range(len(meets))]
        names = [n for n, _ in keys]
        per = []
        for k, (side, own, ids) in enumerate(sides):
            held = [F.count(F.lit(1)).alias(f"rows_{k}"), F.min(self._stamp(side)).alias(f"stamp_{k}")]
            held += [F.first(c).alias(n) for n, c in [*keys, *firsts]] if k == 0 else []
            held += [f(m.value).alias(f"{m.alias}_{f.__name__}") for m in own if not m.distinct for f in m.parts()]
            per.append(side.df.groupBy(*[q(i).alias(a) for i, a in zip(ids, at, strict=True)]).agg(*held))
        both = per[0].join(per[1], at)
        final = [F.min(F.struct("stamp_0", "stamp_1")).alias(h), *[F.first(q(n)).alias(n) for n, _ in firsts]]
        for k, (_, own, _) in enumerate(sides):
            final += [m.joined(F.col(f"rows_{1 - k}")).alias(m.alias) for m in own if not m.distinct]
        final += [F.coalesce(F.sum(F.col("rows_0") * F.col("rows_1")), F.lit(0)).alias(m.alias) for m in made if m.value is None]
        out = both.groupBy(*[q(n) for n in names]).agg(*final)
        for k, (side, own, ids) in enumerate(sides):
            if not (own := [m for m in own if m.distinct]):
                continue
            rows = side.df.select(*[q(i).alias(a) for i, a in zip(ids, at, strict=True)], *([c.alias(n) for n, c in keys] if k == 0 else []), *[m.value.alias(m.alias) for m in own])
            rows = rows.join(per[1].select(*at), at, "left_semi") if k == 0 else rows.join(per[0].select(*at, *[q(n) for n in names]), at)
            part = rows.groupBy(*[q(n).alias(f"part_{n}") for n in names]).agg(*[m.function()(q(m.alias)).alias(m.alias) for m in own])
            if names:
                cond = None
                for n in names:
                    this = q(n).eqNullSafe(q(f"part_{n}"))
                    cond = this if cond is None else cond & this
                out = out.join(part, cond).drop(*[f"part_{n}" for n in names])
            else:
                out = out.crossJoin(part)  # one row each
        self.steps.append("Factored")
        return out

    def aggregate(self, bind: Binder, e: tuple, stamp: Column, made: list[Aggregate]) -> Typed:
        """An expression over aggregates: each becomes a column of the grouping."""
        if e[0] == "func" and e[1] in AGGREGATES:
            _, name, distinct, args = e
            if len(args) != 1:
                raise parse_error(f"{name}() needs one argument")
            if has_aggregate(args[0]):
                raise parse_error("aggregates do not nest")
            alias = self.name("g")
            if args[0] == ("star",):
                made.append(Aggregate(alias, "count", False, None, frozenset(), F.count(F.lit(1))))
                return q(alias), "int"
            c, t = bind.bind(args[0])
            names = frozenset(references(args[0]))
            if name == "count":
                # what is never null needs no column
                sure = args[0][0] == "var" and t in ("node", "rel") and not distinct and args[0][1] in self.sure
                c = F.lit(1) if sure else c
                made.append(Aggregate(alias, name, distinct, c, names, F.count_distinct(c) if distinct else F.count(c)))
                return q(alias), "int"
            if name == "collect":
                part = F.collect_list(F.when(c.isNotNull(), F.struct(stamp.alias("o"), c.alias("v"))))
                made.append(Aggregate(alias, name, distinct, c, names, part))
                listed = F.transform(F.array_sort(q(alias)), lambda x: x["v"])
                return (F.array_distinct(listed) if distinct else listed), ("list", "int" if t in ("node", "rel") else t)
            if name in ("sum", "avg") and t not in ("int", "double", "null"):
                raise parse_error(f"{name}() needs numbers, not {t}")
            kind = "int" if t == "null" else t
            c = c.cast(spark_type(kind))
            found = Aggregate(alias, name, distinct and name in ("sum", "avg"), c, names, F.lit(None))
            made.append(replace(found, whole=found.function()(c)))
            return q(alias), "double" if name == "avg" else kind
        if e[0] in ("var", "prop"):
            raise parse_error("an aggregate does not mix with plain variables")
        if e[0] in ("lit", "param"):
            return bind.bind(e)
        # rebuild the expression with its aggregates as local variables
        holder = Binder(bind.lookup, bind.prop, bind.params)

        def swap(x: Any) -> Any:
            if isinstance(x, tuple) and x and x[0] == "func" and x[1] in AGGREGATES:
                n = self.name("local ")
                holder.local[n] = self.aggregate(bind, x, stamp, made)
                return ("var", n)
            if isinstance(x, tuple) and x and x[0] in ("var", "prop"):
                raise parse_error("an aggregate does not mix with plain variables")
            if isinstance(x, tuple):
                return tuple(swap(y) for y in x)
            return [swap(y) for y in x] if isinstance(x, list) else x

        return holder.bind(swap(e))

    def distinct(self, frame: Frame, p: Projection, columns: list) -> Frame:
        """First-seen order, one row for each set of values."""
        keys = [frame.key(n) for n, _ in columns]
        rest = [c for n, _ in columns for c in frame.columns_of(n) if c not in keys]
        h = self.name()
        df = frame.df.groupBy(*[q(k) for k in keys]).agg(F.min(self._stamp(frame)).alias(h), *[F.first(q(c)).alias(c) for c in rest])
        return Frame(df, frame.scope, ((h, True),))

    def ordered(self, frame: Frame, source: Frame, p: Projection, columns: list, hidden: bool) -> Frame:
        bind = self.binder(frame)
        if p.last:
            # the text of an item stands for it; names of the source hold where the item itself is not hidden
            texts = {repr(i.expr): (n, t) for i, (n, t) in zip(p.items, columns, strict=True)}
            lookup, prop = bind.lookup, bind.prop

            def wide_lookup(name: str) -> Typed:
                if name in frame.scope:
                    return lookup(name)
                if hidden and name in source.scope:
                    v = source.scope[name]
                    return q("s_" + source.key(name)), v.kind if v.kind != "value" else v.type
                raise parse_error(f"unknown variable {name}")

            def wide_prop(name: str, key: str) -> Typed | None:
                if name in frame.scope:
                    return prop(name, key)
                if hidden and name in source.scope and source.scope[name].is_entity:
                    c = f"v_{name}_{P}{key}"
                    if c in source.df.columns:
                        return q("s_" + c), self.graph.types(source.scope[name].kind)[key]
                    return (q(f"s_v_{name}_id"), "int") if key == "id" else literal(None)
                wide_lookup(name)
                return None

            bind = Binder(wide_lookup, wide_prop, self.params)
        df, order = frame.df, []
        for e, up in p.order:
            same = texts.get(repr(e)) if p.last else None
            c = q(frame.key(same[0])) if same else bind.column(e)
            h = self.name()
            df = df.withColumn(h, c)
            order.append((h, up))
        return Frame(df, frame.scope, (*order, *frame.order))

    def limited(self, frame: Frame, p: Projection) -> Frame:
        if p.skip is None and p.limit is None:
            return frame

        def number(e: tuple) -> int:
            v = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else None
            if not isinstance(v, int) or isinstance(v, bool) or v < 0:
                raise parse_error("SKIP and LIMIT need whole numbers")
            return v

        df = frame.sorted()
        if p.skip is not None and number(p.skip):
            df = df.offset(number(p.skip))
        if p.limit is not None:
            df = df.limit(number(p.limit))
        self.steps.append("Limit")
        return replace(frame, df=df)


def result_column(frame: Frame, name: str, t: Any) -> Column:
    return q(frame.key(name)).alias(name)


def union_types(left: list[tuple[str, Any]], right: list[tuple[str, Any]]) -> list[tuple[str, Any]]:
    if [n for n, _ in left] != [n for n, _ in right]:
        raise parse_error("the branches of a UNION return the same columns")
    out = []
    for (n, a), (_, b) in zip(left, right, strict=True):
        a, b = ("int" if x in ("node", "rel") else x for x in (a, b))
        both = unify(a, b)
        if both is None and all(x == "json" or isinstance(x, tuple) and x[0] == "map" for x in (a, b)):
            both = "json"
        if both is None:
            raise parse_error(f"{n} has two types: {a} and {b}")
        out.append((n, both))
    return out


def fit(c: Column, t: Any, wanted: Any) -> Column:
    return as_json(c, t) if wanted == "json" and t not in ("json", "null") else c.cast(spark_type(wanted))
