import json

from graphweft import cli, server
from graphweft.sources import snapshot


def test_commands(spark, tmp_path, capsys):
    db = f"file://{tmp_path}/db"
    (tmp_path / "t.tsv").write_text("oak\tSHADES\tfern\n")

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    assert run("create", db)[0] == 0 and run("create", db)[0] == 1 and run("nonsense")[0] == 2
    assert run("import", db, str(tmp_path / "t.tsv")) == (0, "accepted: 1\nduplicates: 0\n")
    assert run("stats", db) == (0, "nodes: 0\nrelationships: 0\nsymbols: 0\n")
    run("store", db, str(tmp_path / "t.tsv"))
    assert run("stats", db) == (0, "nodes: 2\nrelationships: 1\nsymbols: 2\n")
    assert run("export", db, "-") == (0, "oak\tSHADES\tfern\n")
    assert run("query", db, 'CREATE (p:P {name: "x"}) RETURN p.name', "--format", "json")[1] == json.dumps({"columns": ["p.name"], "rows": [["x"]], "row_count": 1}) + "\n"
    assert run("search", db, "MATCH (p:P) RETURN p.name") == (0, "x\n") and run("search", db, "CREATE (q:Q)")[0] == 1
    assert run("constraint-unique", db, "P", "name")[0] == 0 and run("constraints", db)[1] == "unique\tP\tname\n"
    assert "Expand" in run("explain", "MATCH (a)-[:T]->(b) RETURN a")[1]
    assert "matches: 1\n" in run("bench", f"file://{tmp_path}/bench", "50")[1]


def test_service(spark, tmp_path):
    db = f"file://{tmp_path}/db"
    server.answer(spark, db, "sample", {})
    got = server.answer(spark, db, "query", {"query": "MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name"})
    assert got["rows"] == [["Alice", "Bob"], ["Bob", "Carol"]]
    assert len(server.answer(spark, db, "graph", {})["nodes"]) == 3
    assert snapshot.load(spark, db).stats()["nodes"] == 3
