"""Triples, property files, value codes, snapshots."""

import math

import pytest

from graphweft import values
from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.sources import property_files, snapshot, triples

GOOD = [values.encode(v) for v in (None, True, 40, -7, 2**63 - 1, -(2**63), 6.5, "hé", b"\x7f")]


def spoilt(code):
    """What the grammar of codes forbids, made from a good one: parts dropped, doubled or changed."""
    kind, _, rest = code.partition(":")
    made = [f"{kind}{rest}", f" {code}", f"{code} ", f"{kind};{rest}", f"{kind.upper()}:{rest}", f"k:{rest}", code + "g"]
    if kind == "i":
        made += ["i:0" + rest, "i:+" + rest.lstrip("-"), "i:--" + rest.lstrip("-"), f"i:{rest}.0", f"i:{rest}00000000000000000000"]
    if kind in ("d", "s", "x"):
        made += [code[:-1], code + "0", f"{kind}:{rest[:-1]}-"]
    if kind == "d":
        made += [code[:-2], code + "00"]
    if kind == "b":
        made += ["b:" + str(int(rest) + 2), "b:yes", code * 2]
    return [m for m in made if m not in GOOD and not (kind in ("s", "x") and m == code + "00")]


BAD = sorted({b for g in GOOD for b in spoilt(g)} | {f"{k}:" for k in "bid"} | {"", ":", f"i:{2**63}", f"i:{-(2**63) - 1}", "i:-0"})


@pytest.mark.parametrize("text", BAD)
def test_bad_codes(text):
    with pytest.raises(GraphError):
        values.decode(text)


@pytest.mark.parametrize("value", [None, True, False, 0, -1, 2**63 - 1, -(2**63), 0.0, -0.0, 2.5, "a\0\t\r\n\\x", b"\x00\x09\x0d\x0a"])
def test_codes_round_trip(value):
    back = values.decode(values.encode(value))
    assert back == value and type(back) is type(value)
    if isinstance(value, float):
        assert math.copysign(1, back) == math.copysign(1, value)


def test_codes_in_spark(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(b, False) for b in BAD] + [(values.encode(v), True) for v in (None, True, -5, 2**63 - 1, 1.5, "é", b"\0")], "c string, good boolean")
    assert rows.where(property_files.valid_code(F.col("c")) != F.col("good")).count() == 0
    for v in (0.0, -0.0, 2.5, -1e300, 5e-324, 1.1, float("inf")):
        bits = values.encode(v)[2:]
        got = spark.createDataFrame([(bits,)], "b string").select(property_files.hex_double(F.col("b")).alias("d")).first().d
        assert got == v and math.copysign(1, got) == math.copysign(1, v)


def test_triples(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text("oak\tSHADES\tfern\noak\tSHADES\tfern\r\nfern\tGROWS_ON\tmoss\n")
    got = triples.import_triples(PropertyGraph.empty(spark), str(f))
    assert (got.accepted, got.duplicates, got.graph.node_count()) == (2, 1, 3)
    assert triples.export_triples(got.graph) == "oak\tSHADES\tfern\nfern\tGROWS_ON\tmoss\n"
    again = triples.import_triples(got.graph, str(f))
    assert (again.accepted, again.graph.rel_count()) == (0, 2)
    c = tmp_path / "t.csv"
    c.write_text('"Acer, red",SHADES,"so-called ""dwarf"""\n')
    assert triples.export_triples(triples.import_triples(PropertyGraph.empty(spark), str(c), csv=True).graph) == 'Acer, red\tSHADES\tso-called "dwarf"\n'
    c.write_text("oak,SHADES,fern\noak,fern\n")
    with pytest.raises(GraphError) as e:
        triples.import_triples(PropertyGraph.empty(spark), str(c), csv=True)
    assert e.value.status == "PARSE_ERROR" and e.value.details["line"] == 2


def test_property_files_and_snapshot(spark, tmp_path):
    n, r = tmp_path / "n.tsv", tmp_path / "r.tsv"
    oak = values.encode("Quercus")
    n.write_text(f"node\tt1\tTree,Tall,Tree\tgenus={oak};height=n\nnode\tt2\tTree\tage=i:90\n")
    r.write_text(f"relationship\tr1\tt1\tSHADES\tt2\tsince={values.encode('spring')}\n")
    got = property_files.import_property_graph(PropertyGraph.empty(spark), str(n), str(r))
    assert got.accepted == 3
    g = got.graph
    assert sorted(g.node(1)["labels"]) == ["Tall", "Tree"] and g.node_property(1, "height") is None
    with pytest.raises(GraphError):
        g.node_property(2, "genus")
    out = [str(tmp_path / "on"), str(tmp_path / "or")]
    property_files.export_property_graph(g, *out)
    back = property_files.import_property_graph(PropertyGraph.empty(spark), *out).graph
    lines = lambda x: [[v.value for v in df.orderBy("id").collect()] for df in property_files.property_lines(x)]
    assert lines(back) == lines(g) and lines(g)[0][0].split("\t")[3] == f"genus={oak};height=n"
    with pytest.raises(GraphError) as e:
        property_files.export_property_graph(g, *out)
    assert e.value.status == "EXISTS"
    where = f"file://{tmp_path}/db"
    snapshot.save(g, where)
    snapshot.save(g.add_nodes([(["Z"], {})]), where)
    opened = snapshot.load(spark, where)
    assert opened.stats()["nodes"] == 3 and lines(opened)[0][:2] == lines(g)[0]
    sealed = f"file://{tmp_path}/sealed"
    snapshot.encrypt(g, sealed, "secret")
    assert lines(snapshot.decrypt(spark, sealed, "secret")) == lines(g)
    with pytest.raises(GraphError) as e:
        snapshot.decrypt(spark, sealed, "wrong")
    assert e.value.status == "CORRUPT"
