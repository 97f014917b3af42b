"""Value types, the typed text code of property files, JSON for mixed values, and rendering.

Types of expressions: int, double, string, bool, bytes, null, node, rel, path, json, ("list", t), ("map", {key: t}).
json is the fallback for keys that hold several types, and for stored maps: a canonical JSON text.
"""

from __future__ import annotations

import json
import re
import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.errors import GraphError, parse_error

NUMERIC = ("int", "double")


def type_of(t: T.DataType) -> Any:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "double"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.ArrayType):
        return ("list", type_of(t.elementType))
    if isinstance(t, T.StructType):
        return ("map", {f.name: type_of(f.dataType) for f in t.fields})
    return "string"


def spark_type(t: Any) -> T.DataType:
    if isinstance(t, tuple) and t[0] == "list":
        return T.ArrayType(spark_type(t[1]))
    if isinstance(t, tuple):
        return T.StructType([T.StructField(k, spark_type(x)) for k, x in t[1].items()])
    return {"int": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "node": T.LongType(), "rel": T.LongType(), "null": T.StringType()}.get(t, T.StringType())


def unify(a: Any, b: Any) -> Any:
    """The type that holds both, or None. Null goes with all, int with double."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a if isinstance(a, str) else "", b if isinstance(b, str) else ""} == {"int", "double"}:
        return "double"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "list":
        inner = unify(a[1], b[1])
        return None if inner is None else ("list", inner)
    return None


def literal_type(v: Any) -> Any:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "double"
    if isinstance(v, (bytes, bytearray)):
        return "bytes"
    if isinstance(v, (list, tuple)):
        t: Any = "null"
        for x in v:
            t = unify(t, literal_type(x))
            if t is None:
                return ("list", "json")
        return ("list", t)
    if isinstance(v, dict):
        return ("map", {k: literal_type(x) for k, x in v.items()})
    return "string"


def literal(v: Any) -> tuple[Column, Any]:
    """A value as a column, and its type."""
    t = literal_type(v)
    if isinstance(v, (list, tuple)):
        if t == ("list", "json"):
            return F.array(*[F.lit(to_json(x)) for x in v]), t
        return F.array(*[literal(x)[0] for x in v]).cast(T.ArrayType(spark_type(t[1]))), t
    if isinstance(v, dict):
        return (F.struct(*[literal(x)[0].alias(k) for k, x in v.items()]) if v else F.struct()), t
    if isinstance(v, int) and not isinstance(v, bool):
        if not -(2**63) <= v < 2**63:
            raise parse_error(f"integer {v} does not fit in 64 bits")
        return F.lit(v).cast("long"), t
    if isinstance(v, bytearray):
        v = bytes(v)
    return F.lit(v).cast(spark_type(t)), t


def to_json(v: Any) -> str | None:
    return None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def as_json(c: Column, t: Any) -> Column:
    """A column in canonical JSON; null stays null."""
    if t == "json":
        return c
    if t == "null":
        return F.lit(None).cast("string")
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1))


# the typed text code of property files
_INT = re.compile(r"-?(?:0|[1-9][0-9]*)\Z")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2})*\Z")


def encode(v: Any) -> str:
    if v is None:
        return "n"
    if isinstance(v, bool):
        return f"b:{int(v)}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return "d:" + struct.pack(">d", v).hex()
    if isinstance(v, str):
        return "s:" + v.encode("utf-8", "surrogateescape").hex()
    if isinstance(v, (bytes, bytearray)):
        return "x:" + bytes(v).hex()
    raise GraphError("INVALID_ARGUMENT", f"no text code for {type(v).__name__}")


def decode(text: str) -> Any:
    if text == "n":
        return None
    kind, rest = text[:2], text[2:]
    if kind == "b:" and rest in ("0", "1"):
        return rest == "1"
    if kind == "i:" and _INT.match(rest) and rest != "-0" and -(2**63) <= int(rest) < 2**63:
        return int(rest)
    if kind == "d:" and len(rest) == 16 and _HEX.match(rest):
        return struct.unpack(">d", bytes.fromhex(rest))[0]
    if kind == "s:" and _HEX.match(rest):
        return bytes.fromhex(rest).decode("utf-8", "surrogateescape")
    if kind == "x:" and _HEX.match(rest):
        return bytes.fromhex(rest)
    raise parse_error(f"malformed value {text!r}")


#: What a valid encoded value looks like, for checks inside Spark; the range of integers is checked by try_cast.
CODE_PATTERN = r"^(?:n|b:[01]|i:(?:0|-?[1-9][0-9]*)|d:[0-9a-fA-F]{16}|[sx]:(?:[0-9a-fA-F]{2})*)$"


def render(v: Any, t: Any = None) -> str:
    """Text of a result cell: null, [a, b], {k: v}, strings bare, doubles in their shortest form."""
    if v is None:
        return "null"
    if t == "json":
        return render(json.loads(v))
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        short = repr(v)
        return short[:-2] if short.endswith(".0") else {"nan": "nan", "inf": "inf", "-inf": "-inf"}.get(short, short)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        inner = t[1] if isinstance(t, tuple) and t[0] == "list" else None
        return "[" + ", ".join(render(x, inner) for x in v) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=False)
    if isinstance(v, dict):
        kinds = t[1] if isinstance(t, tuple) and t[0] == "map" else {}
        return "{" + ", ".join(f"{k}: {render(x, kinds.get(k))}" for k, x in v.items()) + "}"
    return str(v)
