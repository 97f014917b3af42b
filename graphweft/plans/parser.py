"""Lexer and recursive-descent parser of the Cypher-style query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from graphweft.errors import parse_error

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
    |(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
    |(?P<string>"[^"]*")
    |(?P<param>\$[A-Za-z_]\w*)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><>|<=|>=|\+=|\.\.|->|<-|[-+*/=<>()\[\]{}:,.;|])""",
    re.VERBOSE,
)
RESERVED = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "ORDER", "SKIP", "LIMIT", "UNION", "AS", "CALL", "YIELD", "ON", "DISTINCT", "AND", "OR", "NOT", "IN", "IS", "CASE", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "BY"}
AGGREGATES = {"count", "sum", "collect", "avg", "min", "max"}
MAX_DEPTH = 64


@dataclass
class NodePattern:
    var: str | None
    label: str | None
    props: list
    anonymous: bool = False


@dataclass
class RelPattern:
    var: str | None
    type: str | None
    props: list
    direction: str  # out, in, both
    length: tuple[int, int] | None
    anonymous: bool = False


@dataclass
class Path:
    var: str | None
    nodes: list[NodePattern]
    rels: list[RelPattern]


@dataclass
class Item:
    expr: tuple
    name: str
    aliased: bool


@dataclass
class Projection:
    items: list[Item]
    distinct: bool = False
    order: list = field(default_factory=list)  # (expr, ascending)
    skip: tuple | None = None
    limit: tuple | None = None
    where: tuple | None = None
    last: bool = False


@dataclass
class Clause:
    kind: str  # match, unwind, create, merge, set, remove, delete, call, with, return
    data: dict


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise parse_error(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.at, self.hidden = 0, 0

    # tokens
    def peek(self, ahead: int = 0) -> tuple:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def word(self, *words: str) -> bool:
        """Whether these keywords come next; takes them."""
        for k, w in enumerate(words):
            kind, text, _ = self.peek(k)
            if kind != "name" or text.upper() != w:
                return False
        self.at += len(words)
        return True

    def op(self, text: str) -> bool:
        if self.peek()[0] == "op" and self.peek()[1] == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            raise parse_error(f"expected {text!r} at {self.peek()[2]}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text, at = self.peek()
        if kind != "name" or text.upper() in RESERVED:
            raise parse_error(f"expected a name at {at}, found {text!r}")
        self.at += 1
        return text

    def symbol(self) -> str:
        """A label, type or key, which may be spelt like a keyword."""
        kind, text, at = self.peek()
        if kind != "name":
            raise parse_error(f"expected a name at {at}, found {text!r}")
        self.at += 1
        return text

    def many(self, one) -> list:
        out = [one()]
        while self.op(","):
            out.append(one())
        return out

    # statements
    def script(self) -> list[list[tuple]]:
        """Queries; each is a list of (union kind or None, clauses)."""
        out = []
        while self.peek()[0] != "end":
            if self.op(";"):
                continue
            out.append(self.query())
            if self.peek()[0] != "end":
                self.need(";")
        if not out:
            raise parse_error("empty query")
        return out

    def query(self) -> list[tuple]:
        branches = [(None, self.branch())]
        while self.word("UNION"):
            kind = "all" if self.word("ALL") else "distinct"
            if kind == "distinct":
                self.word("DISTINCT")
            branches.append((kind, self.branch()))
        return branches

    def branch(self) -> list[Clause]:
        out: list[Clause] = []
        while True:
            if self.word("OPTIONAL"):
                if not self.word("MATCH"):
                    raise parse_error("OPTIONAL needs MATCH")
                out.append(self.match(True))
            elif self.word("MATCH"):
                out.append(self.match(False))
            elif self.word("WITH"):
                out.append(Clause("with", {"projection": self.projection(False)}))
            elif self.word("UNWIND"):
                expr = self.expr()
                if not self.word("AS"):
                    raise parse_error("UNWIND needs AS")
                out.append(Clause("unwind", {"expr": expr, "var": self.name()}))
            elif self.word("CREATE"):
                out.append(Clause("create", {"paths": self.many(self.path)}))
            elif self.word("MERGE"):
                paths, on = self.many(self.path), {"create": [], "match": []}
                while self.word("ON"):
                    which = "create" if self.word("CREATE") else "match" if self.word("MATCH") else None
                    if which is None or not self.word("SET"):
                        raise parse_error("ON needs CREATE SET or MATCH SET")
                    on[which] += self.many(self.assignment)
                out.append(Clause("merge", {"paths": paths, "on": on}))
            elif self.word("SET"):
                out.append(Clause("set", {"sets": self.many(self.assignment)}))
            elif self.word("REMOVE"):
                out.append(Clause("remove", {"items": self.many(self.removal)}))
            elif self.word("DETACH"):
                if not self.word("DELETE"):
                    raise parse_error("DETACH needs DELETE")
                out.append(Clause("delete", {"vars": self.many(self.name)}))
            elif self.word("DELETE"):
                out.append(Clause("delete", {"vars": self.many(self.name)}))
            elif self.word("CALL"):
                out.append(self.call())
            elif self.word("RETURN"):
                out.append(Clause("return", {"projection": self.projection(True)}))
                break
            else:
                break
        if not out:
            raise parse_error(f"expected a clause at {self.peek()[2]}, found {self.peek()[1]!r}")
        if out[-1].kind in ("match", "with", "unwind", "call"):
            raise parse_error("a query ends with RETURN or a write")
        return out

    def match(self, optional: bool) -> Clause:
        paths = self.many(self.path)
        return Clause("match", {"paths": paths, "optional": optional, "where": self.expr() if self.word("WHERE") else None})

    def call(self) -> Clause:
        name = self.name()
        self.need("(")
        args = [] if self.peek()[1] == ")" else self.many(self.expr)
        self.need(")")
        if not self.word("YIELD"):
            raise parse_error("CALL needs YIELD")

        def field_() -> tuple[str, str]:
            f = self.name()
            return f, self.name() if self.word("AS") else f

        return Clause("call", {"name": name, "args": args, "fields": self.many(field_)})

    def assignment(self) -> tuple:
        var = self.name()
        if self.op("."):
            key = self.symbol()
            self.need("=")
            return ("key", var, key, self.expr())
        kind = "merge" if self.op("+=") else "replace" if self.op("=") else None
        if kind is None:
            raise parse_error("SET needs =, += or a key")
        return (kind, var, self.expr())

    def removal(self) -> tuple:
        var = self.name()
        if self.op("."):
            return ("key", var, self.symbol())
        self.need(":")
        return ("label", var, self.symbol())

    def projection(self, last: bool) -> Projection:
        p = Projection([], self.word("DISTINCT"), last=last)
        p.items = self.many(self.item)
        if self.word("ORDER"):
            if not self.word("BY"):
                raise parse_error("ORDER needs BY")

            def key() -> tuple:
                e = self.expr()
                return e, not self.word("DESC") if not self.word("ASC") else True

            p.order = self.many(key)
        if self.word("SKIP"):
            p.skip = self.expr()
        if self.word("LIMIT"):
            p.limit = self.expr()
        if not last and self.word("WHERE"):
            p.where = self.expr()
        return p

    def item(self) -> Item:
        begin = self.peek()[2]
        expr = self.expr()
        end = self.tokens[self.at - 1]
        text = self.text[begin : end[2] + len(end[1])]
        if self.word("AS"):
            return Item(expr, self.name(), True)
        return Item(expr, text, False)

    # patterns
    def path(self) -> Path:
        var = None
        if self.peek()[0] == "name" and self.peek(1)[1] == "=":
            var = self.name()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.peek()[1] in ("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Path(var, nodes, rels)

    def hide(self) -> str:
        self.hidden += 1
        return f"~{self.hidden}"

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.peek()[0] == "name" else None
        label = self.symbol() if self.op(":") else None
        props = self.map() if self.peek()[1] == "{" else []
        self.need(")")
        return NodePattern(var or self.hide(), label, props, var is None)

    def rel(self) -> RelPattern:
        left = self.op("<-")
        if not left:
            self.need("-")
        var = type_ = length = None
        props: list = []
        if self.op("["):
            var = self.name() if self.peek()[0] == "name" else None
            type_ = self.symbol() if self.op(":") else None
            if self.op("*"):
                low = self.depth()
                high = self.depth() if self.op("..") else low
                if not 1 <= low <= high <= MAX_DEPTH:
                    raise parse_error(f"path lengths go from 1 to {MAX_DEPTH}")
                if var is not None:
                    raise parse_error("a variable-length relationship has no variable")
                length = (low, high)
            props = self.map() if self.peek()[1] == "{" else []
            self.need("]")
        if self.op("->"):
            if left:
                raise parse_error("a relationship has one direction")
            direction = "out"
        else:
            self.need("-")
            direction = "in" if left else "both"
        return RelPattern(var or self.hide(), type_, props, direction, length, var is None)

    def depth(self) -> int:
        kind, text, at = self.peek()
        if kind != "number" or not text.isdigit():
            raise parse_error(f"expected a path length at {at}")
        self.at += 1
        return int(text)

    def map(self) -> list[tuple]:
        self.need("{")
        if self.op("}"):
            return []

        def entry() -> tuple:
            k = self.symbol()
            self.need(":")
            return k, self.expr()

        out = self.many(entry)
        self.need("}")
        return out

    # expressions, loosest first
    def expr(self) -> tuple:
        left = self.conjunction()
        while self.word("OR"):
            left = ("bin", "OR", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.word("AND"):
            left = ("bin", "AND", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            kind, text, _ = self.peek()
            if kind == "op" and text in ("=", "<>", "<", "<=", ">", ">="):
                self.at += 1
                left = ("bin", text, left, self.sum())
            elif self.word("IN"):
                left = ("in", left, self.sum())
            elif self.word("IS"):
                negated = self.word("NOT")
                if not self.word("NULL"):
                    raise parse_error("IS needs NULL or NOT NULL")
                left = ("isnull", left, negated)
            else:
                return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek()[0] == "op" and self.peek()[1] in "+-":
            op = self.peek()[1]
            self.at += 1
            left = ("bin", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while self.peek()[0] == "op" and self.peek()[1] in ("*", "/"):
            op = self.peek()[1]
            self.at += 1
            left = ("bin", op, left, self.unary())
        return left

    def unary(self) -> tuple:
        return ("neg", self.unary()) if self.op("-") else self.postfix()

    def postfix(self) -> tuple:
        e = self.atom()
        while True:
            if self.op("."):
                e = ("prop", e, self.symbol())
            elif self.op("["):
                low = None if self.peek()[1] == ".." else self.expr()
                if self.op(".."):
                    e = ("slice", e, low, None if self.peek()[1] == "]" else self.expr())
                else:
                    e = ("index", e, low)
                self.need("]")
            else:
                return e

    def atom(self) -> tuple:
        kind, text, at = self.peek()
        if kind == "number":
            self.at += 1
            return ("lit", int(text) if text.isdigit() else float(text))
        if kind == "string":
            self.at += 1
            return ("lit", text[1:-1])
        if kind == "param":
            self.at += 1
            return ("param", text[1:])
        if kind == "op" and text == "(":
            self.at += 1
            e = self.expr()
            self.need(")")
            return e
        if kind == "op" and text == "[":
            return self.list()
        if kind == "op" and text == "{":
            return ("map", self.map())
        if kind == "name":
            if text.upper() in ("TRUE", "FALSE", "NULL"):
                self.at += 1
                return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
            if text.upper() == "CASE":
                return self.case()
            name = self.name()
            if not self.op("("):
                return ("var", name)
            if self.op("*"):
                self.need(")")
                if name.lower() != "count":
                    raise parse_error(f"{name}(*) is not a function")
                return ("func", "count", False, [("star",)])
            distinct = self.word("DISTINCT")
            args = [] if self.peek()[1] == ")" else self.many(self.expr)
            self.need(")")
            return ("func", name.lower(), distinct, args)
        raise parse_error(f"expected an expression at {at}, found {text!r}")

    def list(self) -> tuple:
        self.need("[")
        if self.peek()[0] == "name" and self.peek(1)[0] == "name" and self.peek(1)[1].upper() == "IN":
            var = self.name()
            self.word("IN")
            source = self.expr()
            where = self.expr() if self.word("WHERE") else None
            made = self.expr() if self.op("|") else None
            self.need("]")
            return ("comp", var, source, where, made)
        if self.op("]"):
            return ("list", [])
        out = self.many(self.expr)
        self.need("]")
        return ("list", out)

    def case(self) -> tuple:
        self.word("CASE")
        subject = None if self.peek()[1].upper() == "WHEN" else self.expr()
        whens = []
        while self.word("WHEN"):
            cond = self.expr()
            if not self.word("THEN"):
                raise parse_error("WHEN needs THEN")
            whens.append((cond, self.expr()))
        other = self.expr() if self.word("ELSE") else ("lit", None)
        if not whens or not self.word("END"):
            raise parse_error("CASE needs WHEN and END")
        return ("case", subject, whens, other)


def parse(text: str) -> list[list[tuple]]:
    return Parser(text).script()


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        if e and e[0] == "func" and e[1] in AGGREGATES:
            return True
        return any(has_aggregate(x) for x in e[1:])
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


def references(e) -> set[str]:
    """Names of variables in an expression."""
    if isinstance(e, tuple):
        if e and e[0] == "var":
            return {e[1]}
        if e and e[0] == "comp":
            return references(e[2]) | (references([e[3], e[4]]) - {e[1]})
        return set().union(*[references(x) for x in e]) if e else set()
    return set().union(*[references(x) for x in e]) if isinstance(e, list) and e else set()
