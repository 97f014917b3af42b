"""Command line over snapshot folders. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
import time
from typing import Any

from graphweft.database import Database, Result
from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.runtime import session
from graphweft.sources import property_files, snapshot, triples
from graphweft.values import render

FORMS = {
    "create": "file", "open": "file", "validate": "file", "stats": "file", "analyze": "file", "analyse": "file",
    "encrypt": "input output password", "decrypt": "input output password",
    "store": "db path", "import": "db path", "store-csv": "db path", "import-csv": "db path", "export": "db path",
    "store-ng": "db nodes rels", "import-ng": "db nodes rels", "export-ng": "db nodes rels",
    "constraint-require": "db label key", "constraint-unique": "db label key", "constraint-drop-require": "db label key", "constraint-drop-unique": "db label key",
    "constraints": "db", "index-create": "db label key", "index-drop": "db label key", "indexes": "db",
    "bench": "file count", "serve": "db port", "search": "db query", "query": "db query", "explain": "query",
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphweft")
    sub = out.add_subparsers(dest="command", required=True)
    for name, args in FORMS.items():
        p = sub.add_parser(name)
        for a in args.split():
            p.add_argument(a, type=int if a in ("count", "port") else str)
        if name == "query":
            p.add_argument("--format", choices=["auto", "verbose", "plain", "json"], default="auto")
        if name == "serve":
            p.add_argument("--auth-env")
    return out


def formatted(result: Result, how: str, width: int = 40) -> str:
    """plain: tab-separated; json: columns, rows, row_count; verbose: a table; auto: verbose on a terminal."""
    names, kinds = [n for n, _ in result.columns], [t for _, t in result.columns]
    rows = [[render(v, t) for v, t in zip(r, kinds, strict=True)] for r in result.rows()]
    if how == "auto":
        how = "verbose" if sys.stdout.isatty() else "plain"
    if how == "json":
        return json.dumps({"columns": names, "rows": rows, "row_count": len(rows)}, ensure_ascii=False) + "\n"
    if how == "plain":
        return "".join("\t".join(r) + "\n" for r in rows)
    cells = [[c if len(c) <= width else c[: width - 1] + "…" for c in r] for r in [names, *rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(names))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], f"({len(rows)} rows)"]) + "\n" if names else ""


def label_of(text: str) -> str | None:
    return None if text in ("", "*", "0") else text


def run(spark: Any, a: argparse.Namespace) -> str:
    c = a.command
    if c == "create":
        if snapshot.exists(spark, a.file):
            raise GraphError("EXISTS", a.file)
        snapshot.save(PropertyGraph.empty(spark), a.file)
        return ""
    if c == "explain":
        return Database(spark).explain(a.query) + "\n"
    if c == "bench":
        return bench(spark, a.file, a.count)
    if c == "encrypt":
        snapshot.encrypt(snapshot.load(spark, a.input), a.output, a.password)
        return ""
    if c == "decrypt":
        snapshot.save(snapshot.decrypt(spark, a.input, a.password), a.output)
        return ""
    path = a.file if hasattr(a, "file") else a.db
    graph = snapshot.load(spark, path)
    if c in ("open", "validate"):
        graph.validate()
        return "status: ok\n"
    if c in ("stats", "analyze", "analyse"):
        return "".join(f"{k}: {v}\n" for k, v in graph.stats().items()) + ("status: ok\n" if c != "stats" else "")
    if c in ("store", "import", "store-csv", "import-csv", "store-ng", "import-ng"):
        got = property_files.import_property_graph(graph, a.nodes, a.rels) if c.endswith("-ng") else triples.import_triples(graph, a.path, csv=c.endswith("-csv"))
        if c.startswith("store"):
            snapshot.save(got.graph, path)
        return f"accepted: {got.accepted}\nduplicates: {got.duplicates}\n"
    if c == "export":
        return triples.export_triples(graph, None if a.path == "-" else a.path) or ""
    if c == "export-ng":
        property_files.export_property_graph(graph, a.nodes, a.rels)
        return ""
    if c == "constraints":
        return "".join(f"{k}\t{label or '*'}\t{key}\n" for k, label, key in graph.constraints)
    if c == "indexes":
        return "".join(f"{label or '*'}\t{key}\n" for label, key in graph.indexes)
    if c.startswith("constraint-"):
        kind, label = c.removeprefix("constraint-").removeprefix("drop-"), label_of(a.label)
        snapshot.save(graph.drop_constraint(kind, label, a.key) if "-drop-" in c else graph.create_constraint(kind, label, a.key), path)
        return ""
    if c.startswith("index-"):
        label = label_of(a.label)
        snapshot.save(graph.create_index(label, a.key) if c == "index-create" else graph.drop_index(label, a.key), path)
        return ""
    if c == "serve":
        from graphweft.server import serve

        serve(spark, path, a.port, a.auth_env)
        return ""
    db = Database(spark, graph)
    result = db.query(a.query, readonly=c == "search")
    out = formatted(result, getattr(a, "format", "plain"))
    if result.mutated:
        snapshot.save(db.graph, path)
    return out


def bench(spark: Any, path: str, count: int) -> str:
    """Create, save, reopen, validate, index and look up a chain of `count` nodes."""
    from pyspark.sql import functions as F

    if not 1 <= count <= 10_000_000:
        raise GraphError("INVALID_ARGUMENT", "count")
    began = time.process_time(), time.time()
    ids = spark.range(1, count + 1)
    nodes = ids.select("id", F.array(F.lit("Bench")).alias("labels"), F.col("id").alias("p_seq"))
    rels = spark.range(1, max(count, 1)).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("NEXT").alias("type"))
    snapshot.save(PropertyGraph.of(nodes, rels, next_node=count + 1, next_rel=max(count, 1)), path)
    graph = snapshot.load(spark, path)
    found = graph.build_index("Bench", "seq").find(count).count()
    return "".join(f"{k}: {v}\n" for k, v in graph.stats().items()) + f"matches: {found}\nseconds: {time.time() - began[1]:.6f}\n"


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        sys.stdout.write(run(session(), a))
    except GraphError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
