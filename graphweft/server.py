"""A small JSON service on the loopback interface, one request at a time, over a snapshot folder."""

from __future__ import annotations

import base64
import hmac
import json
import os
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any

from graphweft.database import Database
from graphweft.errors import GraphError
from graphweft.graph import P, PropertyGraph
from graphweft.sources import snapshot
from graphweft.values import render

#: Nodes and relationships that /api/graph shows at most: a picture, not an export.
SHOWN = 500


def sample(spark: Any) -> PropertyGraph:
    """Alice knows Bob, who knows Carol."""
    g = PropertyGraph.empty(spark).add_nodes([(["Person"], {"name": n}) for n in ("Alice", "Bob", "Carol")])
    return g.add_rels([(1, "KNOWS", 2, {}), (2, "KNOWS", 3, {})])


def answer(spark: Any, path: str, route: str, body: dict) -> dict:
    """One request: the snapshot is opened anew, and saved if it changed."""
    if route == "sample":
        snapshot.save(sample(spark), path)
        return {"status": "ok"}
    graph = snapshot.load(spark, path)
    db = Database(spark, graph)
    if route == "stats":
        return graph.stats()
    if route == "constraints":
        return {"constraints": graph.constraints}
    if route == "indexes":
        return {"indexes": graph.indexes}
    if route == "graph":
        name = P + "name" if P + "name" in graph.nodes.columns else "ext"
        nodes = [{"id": r["id"], "labels": r["labels"], "caption": r[name] or str(r["id"])} for r in graph.nodes.orderBy("id").limit(SHOWN).collect()]
        rels = [r.asDict() for r in graph.rels.select("id", "src", "dst", "type").orderBy("id").limit(SHOWN).collect()]
        return {"nodes": nodes, "relationships": rels}
    if route == "explain":
        return {"plan": db.explain(body["query"])}
    if route in ("constraint-require", "constraint-unique"):
        db.create_constraint(route.removeprefix("constraint-"), body.get("label"), body["key"])
    elif route == "index-create":
        db.create_index(body.get("label"), body["key"])
    elif route in ("query", "query-nodes"):
        result = db.query(body["query"], body.get("params"))
        kinds = [t for _, t in result.columns]
        rows = [[render(v, t) for v, t in zip(r, kinds, strict=True)] for r in result.rows()]
        if result.mutated:
            snapshot.save(db.graph, path)
        return {"columns": [n for n, _ in result.columns], "rows": rows, "row_count": len(rows), "mutated": result.mutated}
    else:
        raise GraphError("NOT_FOUND", route)
    snapshot.save(db.graph, path)
    return {"status": "ok"}


def serve(spark: Any, path: str, port: int, auth_env: str | None = None) -> None:
    """auth_env: an environment variable with user:password for basic authentication."""
    secret = os.environ.get(auth_env, "") if auth_env else None
    if auth_env and ":" not in (secret or ""):
        raise GraphError("INVALID_ARGUMENT", f"{auth_env} holds no user:password")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            self.reply({})

        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            except ValueError:
                return self.send(400, {"error": "not JSON"})
            self.reply(body)

        def reply(self, body: dict) -> None:
            wanted = "Basic " + base64.b64encode((secret or "").encode()).decode()
            if secret is not None and not hmac.compare_digest(self.headers.get("Authorization", ""), wanted):
                return self.send(401, {"error": "authentication"})
            try:
                self.send(200, answer(spark, path, self.path.removeprefix("/api/"), body))
            except GraphError as e:
                self.send(400, {"error": e.message, "status": e.status})
            except KeyError as e:
                self.send(400, {"error": f"missing {e}", "status": "INVALID_ARGUMENT"})

        def send(self, code: int, data: dict) -> None:
            text = json.dumps(data, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args: Any) -> None:
            pass

    with HTTPServer(("127.0.0.1", port), Handler) as server:
        server.serve_forever()
