"""The query language against plain Python: random expressions, every walk of a random graph, and a railway of stations."""

import itertools
import random
from collections import defaultdict

import pytest

from graphweft.database import Database
from graphweft.errors import GraphError
from graphweft.values import render


def cells(*rows):
    return "".join("\t".join(render(v) for v in r) + "\n" for r in rows)


# expressions: trees made at random, evaluated here and there
def integer(r, depth):
    """(text, value) of a whole-number expression; division truncates towards zero."""
    if depth == 0 or r.random() < 0.2:
        n = r.randint(0, 12)
        return str(n), n
    (a, x), (b, y) = integer(r, depth - 1), integer(r, depth - 1)
    kind = r.choice(["+", "-", "*", "/", "neg", "abs", "case", "list", "size"])
    if kind in "+-*":
        return f"({a} {kind} {b})", {"+": x + y, "-": x - y, "*": x * y}[kind]
    if kind == "/":
        d = r.randint(1, 5)
        return f"({a} / {d})", abs(x) // d * (1 if x >= 0 else -1)
    if kind == "neg":
        return f"(-{a})", -x
    if kind == "abs":
        return f"abs({a})", abs(x)
    if kind == "case":
        return f"CASE WHEN {a} < {b} THEN {a} WHEN {a} = {b} THEN 0 ELSE {b} END", x if x < y else 0 if x == y else y
    if kind == "list":
        k = r.choice([0, 1, 2, -1, -2, -3])
        return f"[{a}, {b}, 5][{k}]", [x, y, 5][k]
    return f"size([{a}, {b}] + [{a}])", 3


def boolean(r, depth):
    """Three-valued logic: None is null."""
    if depth == 0:
        return r.choice([("true", True), ("false", False), ("null", None)])
    (a, x), (b, y) = boolean(r, depth - 1), boolean(r, depth - 1)
    kind = r.choice(["AND", "OR", "NOT", "IS NULL", "<", "IN"])
    if kind == "AND":
        return f"({a} AND {b})", False if x is False or y is False else None if x is None or y is None else True
    if kind == "OR":
        return f"({a} OR {b})", True if x is True or y is True else None if x is None or y is None else False
    if kind == "NOT":
        return f"(NOT {a})", None if x is None else not x
    if kind == "IS NULL":
        return f"({a} IS NULL)", x is None
    (m, i), (n, j) = integer(r, 1), integer(r, 1)
    return (f"({m} < {n})", i < j) if kind == "<" else (f"({m} IN [{n}, 3])", i in (j, 3))


@pytest.mark.parametrize("seed", range(4))
def test_random_expressions(spark, seed):
    r = random.Random(seed)
    made = [integer(r, 3) for _ in range(6)] + [boolean(r, 3) for _ in range(6)]
    made = [(t, v) for t, v in made if t != "null"]
    query = "RETURN " + ", ".join(f"{t} AS c{k}" for k, (t, _) in enumerate(made))
    assert Database(spark).execute(query) == cells([v for _, v in made])


TEXTS = ["Gare du Nord", "  padded\t", "ÉTÉ", "", "x"]


def test_text_functions(spark):
    for t in TEXTS:
        got = Database(spark).query("WITH $t AS t RETURN toUpper(t), toLower(t), size(t), trim(t), t + \"|\" + t, toString(t), coalesce(null, t)", {"t": t}).rows()
        assert got == [(t.upper(), t.lower(), len(t), t.strip(" "), f"{t}|{t}", t, t)]


@pytest.mark.parametrize("low,high", list(itertools.product([None, 0, 1, -2, 9], [None, 0, 3, -1, 9])))
def test_slices(spark, low, high):
    listed = [4, 8, 15, 16, 23]
    text = f"WITH {listed} AS n RETURN n[{'' if low is None else low}..{'' if high is None else high}]"
    assert Database(spark).execute(text) == cells([listed[low:high]])


def test_lists_and_maps(spark):
    db = Database(spark)
    assert db.query("WITH [9, 7, 5] AS n RETURN head(n), last(n), tail(n), reverse(n), [k IN n WHERE k > 5 | k - 5], [k IN n | k] + [1]").rows() == [(9, 5, [7, 5], [5, 7, 9], [4, 2], [9, 7, 5, 1])]
    assert db.execute('WITH {line: "M4", stop: {zone: 2}} AS m RETURN m.line, m.stop.zone, m.none') == "M4\t2\tnull\n"
    assert db.execute("UNWIND [[1, 2], [3]] AS pair UNWIND pair AS n RETURN n * 100") == "100\n200\n300\n"
    assert db.execute("UNWIND [] AS n RETURN n") == db.execute("UNWIND null AS n RETURN n") == ""
    assert db.execute("UNWIND [3, 1, 3, 2, 1] AS n RETURN DISTINCT n") == "3\n1\n2\n"
    assert db.execute("UNWIND [2, 3] AS n RETURN n UNION UNWIND [3, 4] AS n RETURN n") == "2\n3\n4\n"
    assert db.execute("UNWIND [2, 3] AS n RETURN n UNION ALL UNWIND [3.5] AS n RETURN n") == "2\n3\n3.5\n"


# patterns: every walk of a random graph, found by trying all sequences of relationships
def sample(seed, nodes=7, rels=14):
    r = random.Random(seed)
    kinds = [r.choice(["Stop", "Depot"]) for _ in range(nodes)]
    return kinds, [(r.randint(1, nodes), r.choice(["RAIL", "ROAD"]), r.randint(1, nodes), r.randint(1, 4)) for _ in range(rels)]


@pytest.fixture(scope="module", params=[1, 2])
def net(request, spark):
    kinds, rels = sample(request.param)
    db = Database(spark)
    db.graph = db.graph.add_nodes([([k], {"name": f"n{i + 1}", "zone": (i * 5) % 3 or None}) for i, k in enumerate(kinds)])
    db.graph = db.graph.add_rels([(a, t, b, {"km": w}) for a, t, b, w in rels]).materialised()
    return db, kinds, rels


def ends(rels, direction):
    for k, (a, t, b, w) in enumerate(rels, 1):
        if direction in ("out", "both"):
            yield k, t, a, b, w
        if direction == "in" or (direction == "both" and a != b):
            yield k, t, b, a, w


ARROWS = {"out": ("-", "->"), "in": ("<-", "-"), "both": ("-", "-")}


@pytest.mark.parametrize("first,second", list(itertools.product(ARROWS, ARROWS)))
def test_two_hops(net, first, second):
    db, kinds, rels = net
    (a, b), (c, d) = ARROWS[first], ARROWS[second]
    got = db.query(f"MATCH (x:Stop){a}[p:RAIL]{b}(y){c}[q]{d}(z:Depot) RETURN id(x), id(p), id(y), id(q), id(z)").rows()
    want = [(x, p, y, s, z) for p, t, x, y, _ in ends(rels, first) for s, _, y2, z, _ in ends(rels, second) if t == "RAIL" and y == y2 and p != s and kinds[x - 1] == "Stop" and kinds[z - 1] == "Depot"]
    assert sorted(got) == sorted(want)


def walks(rels, direction, low, high, type_=None, km=None):
    """(start, relationships, end) of all walks of low to high hops that take no relationship twice."""
    steps = [s for s in ends(rels, direction) if type_ in (None, s[1]) and km in (None, s[4])]
    level, out = [((), a, a) for a in range(1, 8)], []
    for depth in range(1, high + 1):
        level = [((*taken, k), start, b) for taken, start, end in level for k, _, a, b, _ in steps if a == end and k not in taken]
        out += level if depth >= low else []
    return sorted((start, list(taken), end) for taken, start, end in out)


@pytest.mark.parametrize("direction,low,high,type_,km", [("out", 1, 2, None, None), ("in", 2, 3, "ROAD", None), ("both", 1, 3, "RAIL", None), ("out", 4, 5, None, None), ("both", 1, 2, None, 2), ("out", 1, 9, "RAIL", None)])
def test_walks(net, direction, low, high, type_, km):
    db, _, rels = net
    a, b = ARROWS[direction]
    pattern = f"{':' + type_ if type_ else ''}*{low}..{high}{' {km: $km}' if km else ''}"
    got = db.query(f"MATCH p=(x){a}[{pattern}]{b}(y) RETURN id(x), relationships(p), id(y), size(nodes(p))", {"km": km} if km else None).rows()
    assert sorted((x, list(r), y) for x, r, y, _ in got) == walks(rels, direction, low, high, type_, km)
    assert all(n == len(r) + 1 for _, r, _, n in got)


def test_matches_that_share_a_node(net):
    """Aggregates over two patterns that meet at a node, against the rows of their join."""
    db, kinds, rels = net
    rail, road = ([(k, a, b, w) for k, (a, t, b, w) in enumerate(rels, 1) if t == kind] for kind in ("RAIL", "ROAD"))
    joined = [(p, s) for p in rail for s in road if p[2] == s[1]]
    groups = defaultdict(list)
    for p, s in joined:
        groups[p[2]].append((p, s))
    text = "MATCH (x)-[p:RAIL]->(y) MATCH (y)-[q:ROAD]->(z) {where} RETURN id(y) AS y, count(*) AS n, count(DISTINCT x) AS xs, count(DISTINCT z) AS zs, sum(p.km) AS p, sum(q.km) AS q, min(p.km) AS lo, max(q.km) AS hi, avg(q.km) AS mean, count(q.km) AS c"
    for where, keep in (("", lambda p, s: True), ("WHERE q.km > 1", lambda p, s: s[3] > 1), ("WHERE p.km < 4", lambda p, s: p[3] < 4), ("WHERE p.km < q.km", lambda p, s: p[3] < s[3])):
        want = []
        for y, rows in sorted(groups.items()):
            rows = [x for x in rows if keep(*x)]
            if rows:
                qs = [s[3] for _, s in rows]
                want.append((y, len(rows), len({p[1] for p, _ in rows}), len({s[2] for _, s in rows}), sum(p[3] for p, _ in rows), sum(qs), min(p[3] for p, _ in rows), max(qs), sum(qs) / len(qs), len(rows)))
        got = db.query(text.format(where=where)).rows()
        assert sorted(got) == [pytest.approx(w) for w in want]
    one = db.query("MATCH (x)-[:RAIL]->(y) MATCH (y)-[:ROAD]->(z) RETURN count(*) AS n, count(DISTINCT x) AS xs").rows()
    assert one == [(len(joined), len({p[1] for p, _ in joined}))]
    assert db.query("MATCH (x)-[:RAIL]->(y) MATCH (y)-[:NONE]->(z) RETURN count(*) AS n, sum(x.zone) AS s, count(DISTINCT z) AS z").rows() == [(0, None, 0)]


def test_optional_patterns(net):
    db, kinds, rels = net
    far = {x: sorted(b for a, t, b, w in rels if t == "RAIL" and a == x and w > 2) for x in range(1, 8)}
    got = db.query("MATCH (x) OPTIONAL MATCH (x)-[p:RAIL]->(y) WHERE p.km > 2 RETURN id(x), id(y)").rows()
    assert sorted(got, key=str) == sorted([(x, y) for x, ys in far.items() for y in ys or [None]], key=str)
    assert db.query("MATCH (x) OPTIONAL MATCH (x)-[p:RAIL]->(y) WHERE p.km > 2 RETURN id(x), count(*), count(y)").rows() == [(x, max(1, len(ys)), len(ys)) for x, ys in far.items()]
    assert db.query("MATCH (x) OPTIONAL MATCH (x)-[p:RAIL]->(y) WHERE p.km > 2 WITH x, y WHERE y IS NULL RETURN id(x)").rows() == [(x,) for x, ys in far.items() if not ys]


def ordered_by(rows, *keys):
    """rows sorted by (index, ascending) keys: nulls last upwards and first downwards; ties keep their order."""
    for k, up in reversed(keys):
        rows = sorted((x for x in rows if x[k] is not None), key=lambda x: x[k], reverse=not up) if all(x[k] is not None for x in rows) else (
            [*sorted((x for x in rows if x[k] is not None), key=lambda x: x[k]), *[x for x in rows if x[k] is None]] if up else [*[x for x in rows if x[k] is None], *sorted((x for x in rows if x[k] is not None), key=lambda x: x[k], reverse=True)])
    return rows


@pytest.mark.parametrize("zone,name", list(itertools.product([True, False], repeat=2)))
def test_order(net, zone, name):
    db, kinds, _ = net
    rows = [((i * 5) % 3 or None, f"n{i + 1}") for i in range(7)]
    want = ordered_by(rows, (0, zone), (1, name))
    text = f"ORDER BY x.zone {'ASC' if zone else 'DESC'}, x.name {'ASC' if name else 'DESC'}"
    assert db.query(f"MATCH (x) RETURN x.zone, x.name {text}").rows() == want
    assert db.query(f"MATCH (x) RETURN x.zone, x.name {text} SKIP 2 LIMIT 3").rows() == want[2:5]
    assert db.query(f"MATCH (x) WITH x {text} RETURN collect(x.name) AS names").rows() == [([n for _, n in want],)]
    assert db.query(f"MATCH (x) WITH x {text} RETURN DISTINCT x.zone AS zone").rows() == [(z,) for z in dict.fromkeys(z for z, _ in want)]


def test_stamps_of_every_type(spark):
    """Rows sorted downwards stay so in what is collected from them."""
    for values in ([3, -1, 2**62, -(2**62)], [1.5, -0.25, 1e300, -1e300], ["b", "ba", "", "a", "é"], [True, False], [[1, 2], [1], [2], [1, 3]]):
        order = sorted(range(len(values)), key=lambda k: values[k], reverse=True)
        text = [f'"{v}"' if isinstance(v, str) else repr(v) if isinstance(v, float) else render(v) for v in values]
        listed = "[" + ", ".join(f"{{v: {t}, k: {k}}}" for k, t in enumerate(text)) + "]"
        got = Database(spark).query(f"UNWIND {listed} AS m WITH m.v AS v, m.k AS k ORDER BY v DESC RETURN collect(k) AS ks").rows()
        assert got == [(order,)]


BAD = {
    "PARSE_ERROR": [
        "MATCH (s RETURN s", "MATCH (s) WHERE RETURN s", "MATCH (s) RETURN", "RETURN 3 +", "RETURN [4, ]", "RETURN unheard(1)", "MATCH (s) WHERE s.km <> <> 1 RETURN s", "MATCH (s:Stop:Depot) RETURN s",
        "MATCH (s)-[:RAIL*0]->(t) RETURN t", "MATCH (s)-[:RAIL*3..2]->(t) RETURN t", "MATCH (s)-[:RAIL*1..70]->(t) RETURN t", "MATCH (s)-[w:RAIL*2]->(t) RETURN w", "RETURN nobody", "MATCH (s) WITH s.name RETURN s",
        "MATCH (s) RETURN sum()", "MATCH (s) RETURN s.km * count(s)", "MATCH (s) RETURN s LIMIT x", "MATCH (s) RETURN s SKIP -1", "MATCH (s) RETURN s.a AS a, s.b AS a", "RETURN 1 AS a UNION RETURN 1 AS b",
        'RETURN 2 * "two"', "RETURN 1 AS a UNION RETURN true AS a", "CREATE (s)-[:RAIL*2]->(t)", "CREATE (s)--(t)", "MERGE (s)", "MATCH (s) SET t.km = 1", "MATCH (s) DELETE nobody", "CALL nothing() YIELD node AS n RETURN n",
    ],
    "NOT_FOUND": ["RETURN $absent", "MATCH (s) WHERE s.km > $absent RETURN s"],
    "INVALID_ARGUMENT": ["RETURN 5 / (2 - 2)"],
}


@pytest.mark.parametrize("status,text", [(s, t) for s, ts in BAD.items() for t in ts])
def test_errors(spark, status, text):
    with pytest.raises(GraphError) as e:
        Database(spark).execute(text)
    assert e.value.status == status


def test_parameters_explain_procedures(net, spark):
    db, kinds, _ = net
    assert db.query("MATCH (x) WHERE x.name IN $names RETURN id(x)", {"names": ["n2", "n5", "none"], "unused": 0}).rows() == [(2,), (5,)]
    plan = db.explain("MATCH (x)-[:RAIL*1..9]->(y) RETURN count(*)")
    assert "VarExpand" in plan and "Aggregate" in plan
    with pytest.raises(GraphError):
        db.query("MATCH (x) SET x.name = 1", readonly=True)
    db.register_procedure("spread", lambda n: [(n - 1,), (n + 1,)], {"at": "int"})
    assert db.query("MATCH (x) WHERE id(x) = 3 CALL spread(id(x)) YIELD at AS a RETURN a").rows() == [(2,), (4,)]
    db.unregister_procedure("spread")
    walk = db.query("MATCH (x) WHERE id(x) = 1 CALL randomWalk(x, 4, 7) YIELD node AS n RETURN id(n)").rows()
    steps = {(a, b) for a, _, b, _ in sample(1)[1]} | {(a, b) for a, _, b, _ in sample(2)[1]}
    assert walk[0] == (1,) and all((a[0], b[0]) in steps for a, b in itertools.pairwise(walk))


def test_writes(spark):
    db = Database(spark)
    db.execute('UNWIND ["Alma", "Bree", "Cole"] AS n CREATE (s:Station {name: n})')
    assert db.execute('MATCH (a:Station {name: "Alma"}) MATCH (b:Station) WHERE b.name <> "Alma" CREATE (a)-[t:TRACK {km: size(b.name) * 3}]->(b) RETURN b.name, t.km') == "Bree\t12\nCole\t12\n"
    text = 'UNWIND ["Bree", "Dorn", "Dorn"] AS n MERGE (s:Station {name: n}) ON CREATE SET s.opened = true ON MATCH SET s.known = true RETURN s.name, s.opened, s.known'
    assert sorted(db.query(text).rows(), key=str) == sorted([("Bree", None, True), ("Dorn", True, True), ("Dorn", True, True)], key=str)
    assert db.query(text).rows() and db.graph.node_count() == 4
    assert not db.query('MERGE (s:Station {name: "Cole"}) RETURN s').mutated
    assert db.execute('MATCH (s:Station {name: "Cole"}) SET s.zone = 3, s.step = "free" SET s += {zone: null, gates: 2} RETURN s.zone, s.step, s.gates') == "null\tfree\t2\n"
    assert db.execute('MATCH (s:Station {name: "Cole"}) SET s = {label: s.name} RETURN s.name, s.gates, s.label') == "null\tnull\tCole\n"
    assert db.execute('MATCH (s:Station {name: "Dorn"}) REMOVE s.opened, s:Station RETURN s.opened, s.name') == "null\tDorn\n"
    assert db.execute("MATCH (s:Station) RETURN count(*)") == "3\n"
    kept = db.graph
    with pytest.raises(GraphError):
        db.execute('MATCH (s {name: "Bree"}) OPTIONAL MATCH (s)-[:TRACK]->(t) SET t.km = 1')
    assert db.graph is kept
    with pytest.raises(GraphError):
        db.execute('CREATE (s:Station {name: "Late"}) RETURN 1 / 0; MATCH (s) RETURN nobody')
    assert db.graph is kept
    assert db.query('MATCH (s:Station {name: "Alma"}) DETACH DELETE s').mutated
    assert db.execute("MATCH (s)-[t:TRACK]->(u) RETURN count(t)") == "0\n" and db.graph.node_count() == 3
    assert db.execute("MATCH (s:Station) WITH count(s) AS n CREATE (t:Total {n: n}); MATCH (t:Total) RETURN t.n") == "2\n"
    db.graph.validate()


def test_writes_show_in_counts_of_shared_nodes(spark):
    """A pattern's halves are not used once a write has changed the graph."""
    db = Database(spark)
    db.execute('CREATE (a:L {k: 1})-[:R]->(b:M {k: 2}), (c:L {k: 3})-[:R]->(d:M {k: 4})')
    assert db.execute("MATCH (a:L) MATCH (a)-[:R]->(b) SET b.k = 9 RETURN count(DISTINCT b.k), sum(b.k)") == "1\t18\n"


def test_mixed_types(spark):
    db = Database(spark)
    db.execute('CREATE (a:Sign {text: 14, about: {line: "S1", stops: [2, 3]}}), (b:Sign {text: "exit"}), (c:Sign {text: 1.25})')
    assert db.execute("MATCH (s:Sign) RETURN s.text") == "14\nexit\n1.25\n"
    assert db.execute("MATCH (s:Sign) WHERE s.text = 14 RETURN s.about.line, s.about") == "S1\t{line: S1, stops: [2, 3]}\n"
    assert db.execute('MATCH (s:Sign) WHERE s.text = "exit" RETURN id(s)') == "2\n"


def test_constraints_indexes_transactions(spark):
    db = Database(spark)
    db.execute('UNWIND [101, 102] AS n CREATE (t:Train {number: n, depot: "east"})')
    db.create_constraint("unique", "Train", "number")
    db.create_constraint("require", "Train", "depot")
    for text, status in (('CREATE (t:Train {number: 102, depot: "west"})', "EXISTS"), ("CREATE (t:Train {number: 103})", "NOT_FOUND"), ("MATCH (t:Train) SET t.number = 7", "EXISTS"), ("MATCH (t:Train) REMOVE t.depot", "NOT_FOUND")):
        with pytest.raises(GraphError) as e:
            db.execute(text)
        assert e.value.status == status and db.graph.node_count() == 2
    for call in (lambda: db.create_constraint("unique", "Train", "number"), lambda: db.create_constraint("unique", "Train", "depot")):
        with pytest.raises(GraphError) as e:
            call()
        assert e.value.status == "EXISTS"
    work = db.begin()
    work.query('CREATE (t:Train {number: 104, depot: "west"})')
    assert db.graph.node_count() == 2
    work.commit()
    gone = db.begin()
    gone.query("MATCH (t:Train) DETACH DELETE t")
    gone.rollback()
    assert db.graph.node_count() == 3
    with pytest.raises(GraphError):
        gone.commit()
    db.create_index("Train", "depot")
    index = db.graph.build_index("Train", "depot")
    assert sorted(r["id"] for r in index.find("east").collect()) == [1, 2]
    asked = spark.createDataFrame([("west",), ("north",)], "place string")
    assert [(r.place, r.id) for r in index.lookup(asked, "place").collect()] == [("west", 3)]
    db.drop_index("Train", "depot")
    db.drop_constraint("require", "Train", "depot")
    db.execute("CREATE (t:Train {number: 105})")
