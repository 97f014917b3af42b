"""Binding of expressions: static types first, so that all parse errors come before any Spark job."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.errors import GraphError, parse_error
from graphweft.plans.parser import AGGREGATES
from graphweft.values import NUMERIC, as_json, literal, spark_type, unify

Typed = tuple[Column, Any]


class Binder:
    """Turns expressions into typed columns. `lookup` resolves a variable, `prop` a property of a node or relationship."""

    def __init__(self, lookup, prop, params: dict[str, Any] | None = None):
        self.lookup, self.prop, self.params = lookup, prop, params or {}
        self.local: dict[str, Typed] = {}

    def bind(self, e: tuple) -> Typed:
        return getattr(self, "_" + e[0])(*e[1:])

    def column(self, e: tuple) -> Column:
        return self.bind(e)[0]

    def condition(self, e: tuple) -> Column:
        c, t = self.bind(e)
        if t not in ("bool", "null", "json"):
            raise parse_error(f"a condition is a boolean, not {t}")
        return (c == "true") if t == "json" else c.cast("boolean")

    def _lit(self, v: Any) -> Typed:
        return literal(v)

    def _param(self, name: str) -> Typed:
        if name not in self.params:
            raise GraphError("NOT_FOUND", f"parameter ${name}")
        return literal(self.params[name])

    def _var(self, name: str) -> Typed:
        return self.local[name] if name in self.local else self.lookup(name)

    def _prop(self, e: tuple, key: str) -> Typed:
        if e[0] == "var" and e[1] not in self.local:
            found = self.prop(e[1], key)
            if found is not None:
                return found
        c, t = self.bind(e)
        if isinstance(t, tuple) and t[0] == "map":
            if key not in t[1]:
                return literal(None)
            return c.getField(key), t[1][key]
        if t == "json":
            # the parsed value keeps its own JSON type
            return F.to_json(F.variant_get(F.try_parse_json(c), f"$['{key}']", "variant")), "json"
        if t == "null":
            return literal(None)
        raise parse_error(f"{t} has no keys")

    def _list(self, items: list) -> Typed:
        bound = [self.bind(x) for x in items]
        t: Any = "null"
        for _, x in bound:
            t = unify(t, x) if t is not None else None
        if t is None:
            return F.array(*[as_json(c, x) for c, x in bound]), ("list", "json")
        return F.array(*[c.cast(spark_type(t)) for c, _ in bound]).cast(T.ArrayType(spark_type(t))), ("list", t)

    def _map(self, entries: list) -> Typed:
        bound = {k: self.bind(e) for k, e in entries}
        return F.struct(*[c.alias(k) for k, (c, _) in bound.items()]), ("map", {k: t for k, (_, t) in bound.items()})

    def _index(self, e: tuple, i: tuple) -> Typed:
        c, t = self._list_of(e)
        k, kt = self.bind(i)
        if kt not in ("int", "null"):
            raise parse_error("a list index is an integer")
        return F.try_element_at(c, F.when(k >= 0, k + 1).otherwise(k).cast("int")), t

    def _slice(self, e: tuple, low: tuple | None, high: tuple | None) -> Typed:
        c, t = self._list_of(e)
        n = F.size(c)

        def place(x: tuple | None, default: Column) -> Column:
            if x is None:
                return default
            k = self.column(x)
            return F.least(F.greatest(F.when(k < 0, k + n).otherwise(k), F.lit(0)), n).cast("int")

        a, b = place(low, F.lit(0)), place(high, n)
        return F.slice(c, a + 1, F.greatest(b - a, F.lit(0))), ("list", t)

    def _list_of(self, e: tuple) -> Typed:
        c, t = self.bind(e)
        if t == "null":
            return F.lit(None).cast(T.ArrayType(T.StringType())), "null"
        if not (isinstance(t, tuple) and t[0] == "list"):
            raise parse_error(f"expected a list, not {t}")
        return c, t[1]

    def _not(self, e: tuple) -> Typed:
        return ~self.condition(e), "bool"

    def _neg(self, e: tuple) -> Typed:
        c, t = self.bind(e)
        if t not in (*NUMERIC, "null"):
            raise parse_error(f"- needs a number, not {t}")
        return -c.cast(spark_type("int" if t == "null" else t)), "int" if t == "null" else t

    def _isnull(self, e: tuple, negated: bool) -> Typed:
        c, _ = self.bind(e)
        return (c.isNotNull() if negated else c.isNull()), "bool"

    def _in(self, e: tuple, items: tuple) -> Typed:
        c, t = self.bind(e)
        xs, inner = self._list_of(items)
        both = unify(t, inner)
        if both is None:
            return F.when(c.isNotNull() & (F.size(xs) >= 0), F.lit(False)), "bool"
        c, xs = c.cast(spark_type(both)), xs.cast(T.ArrayType(spark_type(both)))
        return F.when(F.size(xs) == 0, F.lit(False)).otherwise(F.exists(xs, lambda x: x == c)), "bool"

    def _bin(self, op: str, a: tuple, b: tuple) -> Typed:
        if op in ("AND", "OR"):
            left, right = self.condition(a), self.condition(b)
            return (left & right if op == "AND" else left | right), "bool"
        (x, s), (y, t) = self.bind(a), self.bind(b)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self._compare(op, x, s, y, t), "bool"
        return self._arith(op, x, s, y, t)

    def _compare(self, op: str, x: Column, s: Any, y: Column, t: Any) -> Column:
        ops = {"=": lambda p, r: p == r, "<>": lambda p, r: p != r, "<": lambda p, r: p < r, "<=": lambda p, r: p <= r, ">": lambda p, r: p > r, ">=": lambda p, r: p >= r}
        known = x.isNotNull() & y.isNotNull()
        s, t = ("int" if u in ("node", "rel") else u for u in (s, t))
        if "json" in (s, t) and s != t:
            other = t if s == "json" else s
            if other in NUMERIC:
                x, y = (F.try_variant_get(F.try_parse_json(c), "$", "double") if u == "json" else c.cast("double") for c, u in ((x, s), (y, t)))
                return ops[op](x, y)
            if other == "string" and op not in ("=", "<>"):
                x, y = (F.try_variant_get(F.try_parse_json(c), "$", "string") if u == "json" else c for c, u in ((x, s), (y, t)))
                return ops[op](x, y)
            return ops[op](as_json(x, s), as_json(y, t))
        both = unify(s, t)
        if both is None:  # values of two kinds are never equal, and have no order
            return F.when(known, F.lit(op == "<>")) if op in ("=", "<>") else F.lit(None).cast("boolean")
        kind = spark_type(both)
        if isinstance(both, tuple) and both[0] == "map":
            return ops[op](F.to_json(x), F.to_json(y))
        return ops[op](x.cast(kind), y.cast(kind))

    def _arith(self, op: str, x: Column, s: Any, y: Column, t: Any) -> Typed:
        if op == "+" and "string" in (s, t) and unify(s, t) == "string":
            return F.concat(x.cast("string"), y.cast("string")), "string"
        if op == "+" and (isinstance(s, tuple) and s[0] == "list" or isinstance(t, tuple) and t[0] == "list"):
            both = unify(s, t) if s != "null" and t != "null" else None
            if both is None:
                raise parse_error(f"{s} + {t}")
            kind = spark_type(both)
            return F.concat(x.cast(kind), y.cast(kind)), both
        if s == "json" or t == "json":
            x, y = (F.try_variant_get(F.try_parse_json(c), "$", "double") if u == "json" else c.cast("double") for c, u in ((x, s), (y, t)))
            s = t = "double"
        if s not in (*NUMERIC, "null") or t not in (*NUMERIC, "null"):
            raise parse_error(f"{s} {op} {t}")
        both = unify(s, t)
        both = "int" if both == "null" else both
        x, y = x.cast(spark_type(both)), y.cast(spark_type(both))
        if op == "/":
            if both == "int":
                return F.call_function("div", x, y), "int"  # truncates; an error by zero
            return x / y, "double"
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), both

    def _comp(self, var: str, source: tuple, where: tuple | None, made: tuple | None) -> Typed:
        c, t = self._list_of(source)
        old, out = self.local.get(var), t

        def within(x: Column, e: tuple, cond: bool) -> Column:
            nonlocal out
            self.local[var] = (x, t)
            if cond:
                return self.condition(e)
            value, out = self.bind(e)
            return value

        if where is not None:
            c = F.filter(c, lambda x: within(x, where, True))
        if made is not None:
            c = F.transform(c, lambda x: within(x, made, False))
        self.local.pop(var, None)
        if old is not None:
            self.local[var] = old
        return c, ("list", out)

    def _case(self, subject: tuple | None, whens: list, other: tuple) -> Typed:
        base = self.bind(subject) if subject is not None else None
        conds = [self.condition(w) if base is None else self._compare("=", *base, *self.bind(w)) for w, _ in whens]
        values = [self.bind(v) for _, v in whens]
        last = self.bind(other)
        t: Any = "null"
        for _, u in [*values, last]:
            t = unify(t, u) if t is not None else None
        cast = (lambda c, u: as_json(c, u)) if t is None else (lambda c, u: c.cast(spark_type(t)))
        out = None
        for cond, (c, u) in zip(conds, values, strict=True):
            out = F.when(cond, cast(c, u)) if out is None else out.when(cond, cast(c, u))
        return out.otherwise(cast(*last)), "json" if t is None else t

    def _star(self) -> Typed:
        raise parse_error("* stands only in count(*)")

    def _func(self, name: str, distinct: bool, args: list) -> Typed:
        if name in AGGREGATES:
            raise parse_error(f"{name}() is not allowed here")
        one = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim}
        if distinct:
            raise parse_error(f"{name}() takes no DISTINCT")
        if name == "coalesce":
            if not args:
                raise parse_error("coalesce() needs arguments")
            bound, t = [self.bind(a) for a in args], "null"
            for _, u in bound:
                t = unify(t, u) if t is not None else None
            if t is None:
                return F.coalesce(*[as_json(c, u) for c, u in bound]), "json"
            return F.coalesce(*[c.cast(spark_type(t)) for c, _ in bound]), t
        if len(args) != 1:
            raise parse_error(f"{name}() needs one argument")
        c, t = self.bind(args[0])
        if name in one:
            if t not in ("string", "null"):
                raise parse_error(f"{name}() needs a string, not {t}")
            return one[name](c.cast("string")), "string"
        if name == "abs":
            if t not in (*NUMERIC, "null"):
                raise parse_error(f"abs() needs a number, not {t}")
            return F.abs(c.cast(spark_type("int" if t == "null" else t))), "int" if t == "null" else t
        if name == "tostring":
            return text_of(c, t), "string"
        if name == "size":
            if t in ("string", "null"):
                return F.length(c.cast("string")).cast("long"), "int"
            xs, _ = self._list_of(args[0])
            return F.when(xs.isNotNull(), F.size(xs)).cast("long"), "int"
        if name == "id":
            if t not in ("node", "rel", "null"):
                raise parse_error(f"id() needs a node or relationship, not {t}")
            return c.cast("long"), "int"
        if name in ("nodes", "relationships"):
            if t != "path":
                raise parse_error(f"{name}() needs a path")
            return c.getField(name), ("list", "int")
        if name in ("head", "last", "tail", "reverse"):
            if name == "reverse" and t == "string":
                return F.reverse(c), "string"
            xs, inner = self._list_of(args[0])
            if name == "head":
                return F.try_element_at(xs, F.lit(1)), inner
            if name == "last":
                return F.try_element_at(xs, F.lit(-1)), inner
            if name == "tail":
                return F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), ("list", inner)
            return F.reverse(xs), ("list", inner)
        raise parse_error(f"unknown function {name}()")


def text_of(c: Column, t: Any) -> Column:
    """What the renderer would print, as a column; null stays null."""
    if t == "string":
        return c
    if t == "double":
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    if isinstance(t, tuple) and t[0] == "list":
        parts = F.transform(c, lambda x: F.coalesce(text_of(x, t[1]), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    if isinstance(t, tuple):
        parts = [F.concat(F.lit(f"{k}: "), F.coalesce(text_of(c.getField(k), u), F.lit("null"))) for k, u in t[1].items()]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return c.cast("string")
