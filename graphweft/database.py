"""A graph with a current version: queries, transactions, procedures, constraints and indexes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import ArithmeticException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.errors import GraphError, parse_error
from graphweft.graph import PropertyGraph
from graphweft.operators.procedures import BUILT_IN, wrapped
from graphweft.plans.compiler import Compiler, Frame, fit, result_column, union_types
from graphweft.plans.parser import parse
from graphweft.plans.writes import Writer
from graphweft.values import render

WRITES = {"create", "merge", "set", "remove", "delete"}


@dataclass
class Result:
    """df: typed columns under their RETURN texts. It is lazy: only walks of over two hops and calls start jobs."""

    df: DataFrame | None
    columns: list[tuple[str, Any]]
    mutated: bool
    plan: list[str]

    def rows(self) -> list[tuple]:
        if self.df is None:
            return []
        try:
            return [tuple(r) for r in self.df.collect()]
        except ArithmeticException as e:
            raise GraphError("INVALID_ARGUMENT", str(e).splitlines()[0]) from e

    def text(self) -> str:
        """Tab-separated cells, a line a row."""
        kinds = [t for _, t in self.columns]
        return "".join("\t".join(render(v, t) for v, t in zip(r, kinds, strict=True)) + "\n" for r in self.rows())


class Database:
    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None):
        self.spark, self.graph = spark, graph or PropertyGraph.empty(spark)
        self.procedures: dict[str, Callable] = dict(BUILT_IN)

    def register_procedure(self, name: str, function: Callable, fields: dict[str, Any]) -> None:
        """function(*scalars) -> rows (tuples in the order of fields). Field types: int, double, string, bool, node."""
        if name in self.procedures:
            raise GraphError("EXISTS", f"procedure {name}")
        self.procedures[name] = wrapped(function, fields)

    def unregister_procedure(self, name: str) -> None:
        if name not in self.procedures:
            raise GraphError("NOT_FOUND", f"procedure {name}")
        del self.procedures[name]

    def query(self, text: str, params: dict[str, Any] | None = None, readonly: bool = False, ordered: bool = True) -> Result:
        """Run a script. Its writes are published together at the end, or not at all.

        ordered: sort rows without ORDER BY in the natural order; off, large results keep whatever order they have.
        """
        script = parse(text)
        if readonly and any(c.kind in WRITES for query in script for _, branch in query for c in branch):
            raise GraphError("INVALID_ARGUMENT", "this query writes")
        graph, mutated, result = self.graph, False, None
        for k, query in enumerate(script):
            last = k == len(script) - 1
            graph, one = self._query(graph, query, params or {}, ordered)
            mutated |= one.mutated
            if one.columns or last:
                result = one
        if mutated:
            graph.check_constraints()
            self.graph = graph
        result.mutated = mutated
        return result

    def execute(self, text: str, params: dict[str, Any] | None = None) -> str:
        return self.query(text, params).text()

    def explain(self, text: str, params: dict[str, Any] | None = None) -> str:
        """The clauses' operators, in order; nothing is run or written."""
        lines: list[str] = []
        for query in parse(text):
            for kind, branch in query:
                compiler = Compiler(self.graph, params, self.procedures)
                compiler.dry = True
                if any(c.kind in WRITES for c in branch):
                    lines += [c.kind.capitalize() for c in branch]
                else:
                    self._branch(compiler, branch)
                    lines += compiler.steps
                if kind:
                    lines.append(f"Union({kind})")
        return " -> ".join(lines)

    def _query(self, graph: PropertyGraph, branches: list[tuple], params: dict, ordered: bool) -> tuple[PropertyGraph, Result]:
        parts: list[tuple[str | None, Frame, list, Compiler]] = []
        mutated = False
        if len(branches) > 1:
            self._same_shape(branches)
        for kind, clauses in branches:
            compiler = Compiler(graph, params, self.procedures)
            frame, columns, wrote = self._branch(compiler, clauses)
            graph, mutated = compiler.graph, mutated | wrote
            parts.append((kind, frame, columns, compiler))
        steps = [s for p in parts for s in p[3].steps]
        if len(parts) == 1:
            _, frame, columns, _ = parts[0]
            if not columns:
                return graph, Result(None, [], mutated, steps)
            df = frame.sorted() if ordered else frame.df
            return graph, Result(df.select(*[result_column(frame, n, t) for n, t in columns]), columns, mutated, steps)
        columns = parts[0][2]
        for p in parts[1:]:
            columns = union_types(columns, p[2])
        if not columns:
            return graph, Result(None, [], mutated, steps)
        out = None
        for k, (kind, frame, own, _) in enumerate(parts):
            own_types = dict(own)
            df = frame.sorted() if ordered else frame.df
            df = df.select(*[fit(result_column(frame, n, own_types[n]), own_types[n], t).alias(n) for n, t in columns])
            df = df.withColumns({"__branch": F.lit(k), "__row": F.monotonically_increasing_id()}) if ordered else df
            out = df if out is None else out.unionByName(df)
            if kind == "distinct":
                names = [n for n, _ in columns]
                keys = [F.col(f"`{n}`") for n in names]
                if ordered:
                    out = out.groupBy(*keys).agg(F.min(F.struct("__branch", "__row")).alias("__o")).select(*keys, "__o.*")
                else:
                    out = out.distinct()
        if ordered:
            out = out.orderBy("__branch", "__row").drop("__branch", "__row")
        return graph, Result(out, columns, mutated, steps)

    def _same_shape(self, branches: list[tuple]) -> None:
        """Branches agree in their columns before any of them runs."""
        shapes = [[i.name for i in c[-1].data["projection"].items] if c[-1].kind == "return" else [] for _, c in branches]
        if any(s != shapes[0] for s in shapes):
            raise parse_error("the branches of a UNION return the same columns")

    def _branch(self, compiler: Compiler, clauses: list) -> tuple[Frame, list, bool]:
        frame, columns = compiler.start(), []
        writer = Writer(compiler)
        fresh = True
        for c in clauses:
            d = c.data
            if c.kind == "match":
                frame = Frame(frame.df, {}, ()) if fresh and not d["optional"] else frame
                frame = compiler.match(frame, d["paths"], d["where"], d["optional"])
            elif c.kind == "unwind":
                frame = compiler.unwind(frame, d["expr"], d["var"])
            elif c.kind in ("with", "return"):
                frame, columns = compiler.project(frame, d["projection"])
                columns = columns if c.kind == "return" else []
            elif c.kind == "call":
                frame = compiler.call(frame, d["name"], d["args"], d["fields"])
            elif c.kind == "create":
                frame = writer.create(frame, d["paths"])
            elif c.kind == "merge":
                frame = writer.merge(frame, d["paths"], d["on"])
            elif c.kind == "set":
                frame = writer.set(frame, d["sets"])
            elif c.kind == "remove":
                frame = writer.remove(frame, d["items"])
            elif c.kind == "delete":
                frame = writer.delete(frame, d["vars"])
            fresh = False
        return frame, columns, writer.mutated

    # transactions
    def begin(self) -> Transaction:
        return Transaction(self)

    # metadata, each a new version
    def create_constraint(self, kind: str, label: str | None, key: str) -> None:
        self.graph = self.graph.create_constraint(kind, label, key)

    def drop_constraint(self, kind: str, label: str | None, key: str) -> None:
        self.graph = self.graph.drop_constraint(kind, label, key)

    def create_index(self, label: str | None, key: str) -> None:
        self.graph = self.graph.create_index(label, key)

    def drop_index(self, label: str | None, key: str) -> None:
        self.graph = self.graph.drop_index(label, key)


class Transaction:
    """Works on a version of its own; commit() checks and publishes it, rollback() forgets it."""

    def __init__(self, base: Database):
        self.base = base
        self.work = Database(base.spark, base.graph)
        self.work.procedures = base.procedures
        self.open = True

    def query(self, *args, **options) -> Result:
        self._usable()
        return self.work.query(*args, **options)

    def commit(self) -> None:
        self._usable()
        self.work.graph.validate()
        self.base.graph, self.open = self.work.graph, False

    def rollback(self) -> None:
        self._usable()
        self.open = False

    def _usable(self) -> None:
        if not self.open:
            raise GraphError("INVALID_ARGUMENT", "the transaction is over")
