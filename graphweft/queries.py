"""Queries of the engine over the star-schema tables, and the SQL that gives the same rows.

Each entry runs over whole tables. Text queries go through the query language; algorithms through their operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.database import Database
from graphweft.graph import P, PropertyGraph
from graphweft.operators import centrality, components, embeddings, graphsage, paths, structure, vectors, walks
from graphweft.runtime import work_dir
from graphweft.sources import property_files, snapshot, tables, triples

Query = Callable[[SparkSession, str], DataFrame]
STEP = tables.STEP


def text(query: str, params: dict | None = None, **rename: str) -> Query:
    """A query of the language; columns are renamed to plain names."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the oracle compares sets of rows: no final sort is asked for
        result = Database(spark, tables.load(spark, sf_dir)).query(query, params, readonly=True, ordered=False)
        return result.df

    return run


def traded(op: Callable[[PropertyGraph], DataFrame], heaviest: int = 3) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(tables.trades(spark, sf_dir, heaviest).materialised())

    return run


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _broken(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers, nations and orders' graph without its regions, under two constraints that do not hold."""
    g = tables.load(spark, sf_dir, events=False)
    nodes = g.nodes.where(~F.array_contains("labels", "Region"))
    return PropertyGraph.of(nodes, g.rels, next_node=g.next_node, next_rel=g.next_rel, constraints=(("unique", "Customer", "segment"), ("require", "Order", "segment")))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# flagship
add("flagship", text("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) MATCH (c)-[p:PLACED]->(o:Order) WHERE o.price > 1000 RETURN r.name AS region, n.name AS nation, count(o) AS orders, sum(o.price) AS revenue"),
    "SELECT r_name AS region, n_name AS nation, count(*) AS orders, sum(o_totalprice) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2")
QUERIES["flagship"] = (lambda q: lambda spark, d: six(q(spark, d), "revenue"))(QUERIES["flagship"])
ORACLES["flagship"] = "SELECT region, nation, orders, round(revenue, 6) AS revenue FROM (" + ORACLES["flagship"] + ")"

# projections and predicates
add("p_return_props", text("MATCH (c:Customer) RETURN id(c) AS id, c.name AS name, c.balance AS balance, c.segment AS segment"),
    f"SELECT {3 * STEP + 1} + c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
add("p_where_and_or_not", text('MATCH (c:Customer) WHERE (c.balance > 5000 AND NOT c.segment = "BUILDING") OR c.balance < 0 RETURN c.name AS name'),
    "SELECT c_name AS name FROM customer WHERE (c_acctbal > 5000 AND NOT c_mktsegment = 'BUILDING') OR c_acctbal < 0")
add("p_in_list", text('MATCH (o:Order) WHERE o.status IN ["O", "P"] RETURN o.status AS status, count(*) AS n'), "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
add("p_is_null", text("MATCH (n) WHERE n.balance IS NULL AND n.name IS NOT NULL RETURN n.name AS name"),
    "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_name FROM part UNION ALL (SELECT DISTINCT event_type FROM events)")
add("p_distinct", text("MATCH (c:Customer) RETURN DISTINCT c.segment AS segment"), "SELECT DISTINCT c_mktsegment AS segment FROM customer")
add("p_params", text("MATCH (c:Customer) WHERE c.balance >= $low AND c.segment IN $segments RETURN c.name AS name", {"low": 9000.0, "segments": ["BUILDING", "MACHINERY"]}),
    "SELECT c_name AS name FROM customer WHERE c_acctbal >= 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
add("p_arith", text("MATCH (p:Part) RETURN p.name AS name, p.size + 1 AS plus, p.size * 2 - 3 AS mixed, p.size / 7 AS quotient, -p.size AS minus"),
    "SELECT p_name AS name, CAST(p_size + 1 AS BIGINT) AS plus, CAST(p_size * 2 - 3 AS BIGINT) AS mixed, CAST(p_size // 7 AS BIGINT) AS quotient, CAST(-p_size AS BIGINT) AS minus FROM part")
add("p_concat", text('MATCH (n:Nation) RETURN n.name + "-" + toLower(n.name) AS both'), "SELECT n_name || '-' || lower(n_name) AS both FROM nation")
add("p_id", text(f"MATCH (n) WHERE id(n) = {3 * STEP + 8} RETURN n.name AS name"), "SELECT c_name AS name FROM customer WHERE c_custkey = 7")
add("p_inline_map", text('MATCH (c:Customer {segment: "BUILDING"})-[:IN_NATION]->(n) RETURN n.name AS nation, count(c) AS n'), "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")

# expressions
add("f_string", text('MATCH (c:Customer) RETURN c.name AS name, toUpper(c.segment) AS up, size(c.name) AS n, trim("  x ") AS t, toString(c.balance > 0) AS s'),
    "SELECT c_name AS name, upper(c_mktsegment) AS up, CAST(length(c_name) AS BIGINT) AS n, 'x' AS t, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS s FROM customer")
add("f_list_index", text("MATCH (p:Part) WITH [p.size, p.size * 2, 7] AS xs RETURN xs[0] AS a, xs[-1] AS b, xs[1] AS c, size(xs) AS n"), "SELECT CAST(p_size AS BIGINT) AS a, CAST(7 AS BIGINT) AS b, CAST(p_size * 2 AS BIGINT) AS c, CAST(3 AS BIGINT) AS n FROM part")
add("f_list_slice", text("MATCH (p:Part) WITH [p.size, 5, 6, 7] AS xs RETURN toString(xs[1..3]) AS s, toString(tail(xs)) AS t, head(xs) AS h, last(xs) AS l, toString(reverse(xs)) AS r"),
    "SELECT '[5, 6]' AS s, '[5, 6, 7]' AS t, CAST(p_size AS BIGINT) AS h, CAST(7 AS BIGINT) AS l, '[7, 6, 5, ' || p_size || ']' AS r FROM part")
add("f_list_comp", text("MATCH (p:Part) RETURN toString([x IN [p.size, 10, 30] WHERE x > 9 | x * 2]) AS s"), "SELECT '[' || CASE WHEN p_size > 9 THEN (p_size * 2) || ', ' ELSE '' END || '20, 60]' AS s FROM part")
add("f_case_searched", text('MATCH (c:Customer) RETURN CASE WHEN c.balance >= 5000 THEN "high" WHEN c.balance >= 0 THEN "low" ELSE "debt" END AS class, count(*) AS n'), "SELECT CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'low' ELSE 'debt' END AS class, count(*) AS n FROM customer GROUP BY 1")
add("f_case_simple", text('MATCH (o:Order) RETURN CASE o.status WHEN "O" THEN 1 WHEN "F" THEN 2 ELSE 3 END AS code, count(*) AS n'), "SELECT CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS BIGINT) AS code, count(*) AS n FROM orders GROUP BY 1")
add("f_coalesce", text('MATCH (n:Nation) RETURN coalesce(n.missing, n.name, "none") AS v, abs(-3) AS a'), "SELECT n_name AS v, CAST(3 AS BIGINT) AS a FROM nation")
add("f_map_access", text("MATCH (p:Part) WITH {size: p.size, deep: {price: p.price}} AS m RETURN m.size AS size, m.deep.price AS price"), "SELECT CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part")

# joins
add("j_out", text("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS customer, o.price AS price"), "SELECT c_name AS customer, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey")
add("j_in", text("MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier"), "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey")
add("j_undirected", text("MATCH (n:Nation)-[:IN_REGION]-(x) RETURN n.name AS nation, x.name AS other"), "SELECT n_name AS nation, r_name AS other FROM nation JOIN region ON n_regionkey = r_regionkey")
add("j_chain2", text("MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN c.name AS customer, r.name AS region"), "SELECT c_name AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("j_chain3_mixed", text("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS orders"),
    "SELECT r_name AS region, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("j_parallel", text("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.discount > 0.05 RETURN p.brand AS brand, count(l) AS n, count(DISTINCT p) AS parts"),
    "SELECT p_brand AS brand, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.05 GROUP BY 1")
add("j_var_1_2", text("MATCH (c:Customer)-[*1..2]->(x:Region) RETURN x.name AS region, count(*) AS n"), "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("j_var_fixed2", text("MATCH (a:Event)-[:NEXT*2]->(b:Event) RETURN id(a) AS a, id(b) AS b"),
    f"WITH e AS (SELECT event_id, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT {9 * STEP + 1} + event_id AS a, {9 * STEP + 1} + b AS b FROM e WHERE b IS NOT NULL")
add("j_var_prop", text("MATCH (o:Order)-[:CONTAINS*1..2 {discount: $d}]->(p) RETURN p.brand AS brand, count(*) AS n", {"d": 0.05}), "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_discount = 0.05 GROUP BY 1")
add("j_cartesian", text("MATCH (a:Region) MATCH (b:Nation) RETURN a.name AS a, b.name AS b"), "SELECT r_name AS a, n_name AS b FROM region CROSS JOIN nation")
add("j_shared_var", text("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS nation, count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers"),
    "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("j_optional", text("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.name AS name, count(o) AS orders"), "SELECT c_name AS name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
add("j_optional_where", text("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.price > 300000 RETURN c.name AS name, o.price AS price"), "SELECT c_name AS name, o_totalprice AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
add("j_optional_chain", text("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) OPTIONAL MATCH (s)<-[:SUPPLIED_BY]-(o:Order) RETURN n.name AS nation, count(DISTINCT s) AS suppliers, count(o) AS lines"),
    "SELECT n_name AS nation, count(DISTINCT s_suppkey) AS suppliers, count(l_orderkey) AS lines FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
add("j_anti", text("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.price > 400000 WITH c, o WHERE o IS NULL RETURN c.name AS name"), "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL)")
add("j_unwind_match", text('UNWIND ["BUILDING", "MACHINERY", "NONE"] AS s MATCH (c:Customer {segment: s})-[:IN_NATION]->(n) RETURN s AS segment, n.name AS nation, count(c) AS n'), "SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'NONE') GROUP BY 1, 2")
add("j_shared_sums", text("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS nation, count(*) AS pairs, count(DISTINCT s) AS suppliers, min(c.balance) AS low, max(s.balance) AS high"),
    "SELECT n_name AS nation, count(*) AS pairs, count(DISTINCT s_suppkey) AS suppliers, min(c_acctbal) AS low, max(s_acctbal) AS high FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("j_path", text("MATCH p=(c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN size(nodes(p)) AS nodes, nodes(p)[2] AS region, size(relationships(p)) AS rels, count(*) AS n"),
    f"SELECT CAST(3 AS BIGINT) AS nodes, {STEP + 1} + n_regionkey AS region, CAST(2 AS BIGINT) AS rels, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2")

# aggregation, order, sets
add("g_count", text("MATCH (n) RETURN count(*) AS n"), "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) + count(DISTINCT event_type) + count(*) FROM events) AS n")
add("g_sum", (lambda q: lambda s, d: six(q(s, d), "total"))(text("MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN sum(l.quantity) AS total, count(l.quantity) AS n")), "SELECT round(sum(l_quantity), 6) AS total, count(l_quantity) AS n FROM lineitem")
add("g_collect_sorted", text("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.name RETURN r.name AS region, toString(collect(n.name)) AS nations"), "SELECT r_name AS region, '[' || string_agg(n_name, ', ' ORDER BY n_name) || ']' AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
add("g_collect_desc", text("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.name DESC RETURN r.name AS region, toString(collect(n.name)) AS nations"), "SELECT r_name AS region, '[' || string_agg(n_name, ', ' ORDER BY n_name DESC) || ']' AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
add("g_collect_distinct", text("MATCH (c:Customer)-[:IN_NATION]->(n) WITH c, n ORDER BY c.segment RETURN n.name AS nation, toString(collect(DISTINCT c.segment)) AS segments"), "SELECT n_name AS nation, '[' || string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) || ']' AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
add("f_list_concat", text("MATCH (p:Part) RETURN toString([p.size] + [1, 2]) AS s, size([p.size] + []) AS n"), "SELECT '[' || p_size || ', 1, 2]' AS s, CAST(1 AS BIGINT) AS n FROM part")
add("g_count_distinct", text("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(DISTINCT c) AS customers, count(DISTINCT o.status) AS statuses, count(o) AS orders"), "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses, count(*) AS orders FROM orders")
add("g_group", text("MATCH (o:Order) RETURN o.status AS status, o.priority AS priority, count(*) AS n"), "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
add("g_having", text("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 12 RETURN c.name AS name, n"), "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12")
add("o_order_nulls", text("MATCH (n) WITH n.name AS name, n.balance AS balance ORDER BY balance DESC, name SKIP 2 LIMIT 10 RETURN name, balance"),
    f"WITH n AS (SELECT r_name AS name, NULL::DOUBLE AS balance FROM region UNION ALL SELECT n_name, NULL FROM nation UNION ALL SELECT c_name, c_acctbal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier UNION ALL SELECT p_name, NULL FROM part UNION ALL SELECT NULL, NULL FROM orders UNION ALL (SELECT DISTINCT event_type, NULL::DOUBLE FROM events) UNION ALL (SELECT DISTINCT NULL, user_id * NULL::DOUBLE FROM events) UNION ALL SELECT NULL, NULL FROM events) SELECT name, balance FROM n ORDER BY balance DESC NULLS FIRST, name NULLS LAST LIMIT 10 OFFSET 2")
add("o_topk", text("MATCH (o:Order) RETURN id(o) AS id, o.price AS price ORDER BY o.price DESC, id(o) LIMIT 20"), f"SELECT {6 * STEP + 1} + o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("o_skip_limit", text("MATCH (n:Nation) RETURN n.name AS name ORDER BY n.name SKIP 5 LIMIT 5"), "SELECT n_name AS name FROM nation ORDER BY n_name LIMIT 5 OFFSET 5")
add("o_natural", text("MATCH (c:Customer) RETURN c.name AS name, c.segment AS segment SKIP 3 LIMIT 40"), "SELECT c_name AS name, c_mktsegment AS segment FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 3")
add("o_natural_distinct", text("MATCH (c:Customer) RETURN DISTINCT c.segment AS segment LIMIT 3"), "SELECT c_mktsegment AS segment FROM customer GROUP BY 1 ORDER BY min(c_custkey) LIMIT 3")
add("o_after_with", text("MATCH (c:Customer) WITH c ORDER BY c.balance DESC, c.name LIMIT 25 MATCH (c)-[:IN_NATION]->(n) RETURN c.name AS name, n.name AS nation LIMIT 10"), "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_name LIMIT 10")
add("o_union", text("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.name AS name UNION MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS name"), "SELECT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
add("o_union_all", text("MATCH (c:Customer) RETURN c.name AS name, c.balance AS balance UNION ALL MATCH (s:Supplier) RETURN s.name AS name, s.balance AS balance"), "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
add("o_unwind", text("UNWIND [1, 2, 3] AS x MATCH (r:Region) RETURN x, r.name AS region, x * 10 AS y"), "SELECT CAST(x AS BIGINT) AS x, r_name AS region, CAST(x * 10 AS BIGINT) AS y FROM region CROSS JOIN (VALUES (1), (2), (3)) t(x)")
add("c_unique", lambda s, d: tables.load(s, d).violations("unique", "Customer", "segment").select(F.col("first").alias("a"), F.col("second").alias("b")),
    f"SELECT {3 * STEP + 1} + min(c_custkey) AS a, {3 * STEP + 1} + min(c_custkey) FILTER (WHERE k > 1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer) GROUP BY c_mktsegment HAVING count(*) > 1")
add("c_required", lambda s, d: tables.load(s, d).violations("require", None, "name").groupBy().agg(F.count("first").alias("n")), "SELECT (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) + count(*) FROM events) AS n")
add("s_validate", lambda s, d: tables.load(s, d).problems().groupBy("problem").agg(F.count(F.lit(1)).alias("n")), "SELECT 'x' AS problem, CAST(1 AS BIGINT) AS n WHERE false")
add("s_problems", lambda s, d: _broken(s, d).problems().groupBy("problem").agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'dangling dst' AS problem, count(*) AS n FROM nation UNION ALL SELECT 'unique', count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'require', count(*) FROM orders")
add("s_counts", lambda s, d: s.createDataFrame([(k, v) for k, v in tables.load(s, d).stats().items() if k != "symbols"], "what string, n long"),
    "SELECT 'nodes' AS what, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) + count(DISTINCT event_type) + count(*) FROM events) AS n UNION ALL SELECT 'relationships', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT 2 * count(*) - count(DISTINCT user_id) FROM events)")
add("s_stats", lambda s, d: tables.load(s, d).rels.groupBy("type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'PERFORMED', count(*) FROM events UNION ALL SELECT 'NEXT', count(*) - count(DISTINCT user_id) FROM events")
add("s_find_nodes", lambda s, d: tables.load(s, d).find_nodes("Part", "size", 7).select("id", F.col(P + "name").alias("name")), f"SELECT {5 * STEP + 1} + p_partkey AS id, p_name AS name FROM part WHERE p_size = 7")
add("s_relationships", lambda s, d: tables.load(s, d).relationships_of(2 * STEP + 4, "both").select("id", "type", "src", "dst"),
    f"SELECT {11 * STEP + 1} + n_nationkey AS id, 'IN_REGION' AS type, {2 * STEP + 1} + n_nationkey AS src, {STEP + 1} + n_regionkey AS dst FROM nation WHERE n_nationkey = 3 UNION ALL SELECT {12 * STEP + 1} + c_custkey, 'IN_NATION', {3 * STEP + 1} + c_custkey, {2 * STEP + 1} + c_nationkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {13 * STEP + 1} + s_suppkey, 'BASED_IN', {4 * STEP + 1} + s_suppkey, {2 * STEP + 1} + s_nationkey FROM supplier WHERE s_nationkey = 3")

# algorithms on the trade graph
TRADES = f"""WITH RECURSIVE flow AS (
  SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM flow) WHERE r <= 3),
v AS (SELECT n_nationkey AS id FROM nation),
u AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e),
nb AS (SELECT a AS x, b AS y FROM u UNION SELECT b, a FROM u),
k AS (SELECT x AS id, count(*) AS k FROM nb GROUP BY 1)"""
BASE = 2 * STEP + 1

for _d, _c in (("out", "SELECT a AS id FROM e"), ("in", "SELECT b AS id FROM e"), ("either", "SELECT a AS id FROM e UNION ALL SELECT b FROM e")):
    add(f"a_degree_{_d}", traded(lambda g, d=_d: centrality.degree(g, "TRADES", "both" if d == "either" else d)), f"{TRADES}, d AS (SELECT id, count(*) AS n FROM ({_c}) GROUP BY 1) SELECT {BASE} + v.id AS id, coalesce(n, 0) AS degree FROM v LEFT JOIN d USING (id)")


def _rank_sql(rounds: int) -> str:
    sql = TRADES + ", k0 AS (SELECT a, count(*) AS k FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(f.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT a FROM e)) / (SELECT count(*) FROM v)) AS r FROM v LEFT JOIN (SELECT b, sum(r / k) AS s FROM e JOIN k0 USING (a) JOIN r{i} ON r{i}.id = e.a GROUP BY 1) f ON f.b = v.id)"
    return sql + f" SELECT {BASE} + id AS id, round(r, 6) AS rank FROM r{rounds}"


def _eigen_sql(rounds: int) -> str:
    sql = TRADES + ", m AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r0 AS (SELECT id, 1.0::DOUBLE AS r FROM v)"
    for i in range(rounds):
        sql += f", s{i + 1} AS (SELECT v.id, coalesce(f.s, 0) AS r FROM v LEFT JOIN (SELECT m.a, sum(r) AS s FROM m JOIN r{i} ON r{i}.id = m.b GROUP BY 1) f ON f.a = v.id), r{i + 1} AS (SELECT id, r / sqrt((SELECT sum(r * r) FROM s{i + 1})) AS r FROM s{i + 1})"
    return sql + f" SELECT {BASE} + id AS id, round(r, 6) AS score FROM r{rounds}"


DIST = ", dist(s, id, d) AS (SELECT id, id, 0 FROM v UNION SELECT s, b, d + 1 FROM dist JOIN e ON dist.id = e.a WHERE d < 25), best AS (SELECT s, id, min(d) AS d FROM dist GROUP BY 1, 2)"
add("a_pagerank", traded(lambda g: six(centrality.pagerank(g, "TRADES", 0.85, 10), "rank")), _rank_sql(10))
add("a_eigenvector", traded(lambda g: six(centrality.eigenvector(g, "TRADES", 8), "score")), _eigen_sql(8))
add("a_closeness", traded(lambda g: six(centrality.closeness(g, "TRADES"), "score")), f"{TRADES}{DIST} SELECT {BASE} + s AS id, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1.0) / sum(d) * (count(*) - 1.0) / ((SELECT count(*) FROM v) - 1) ELSE 0 END, 6) AS score FROM best GROUP BY s")
add("a_harmonic", traded(lambda g: six(centrality.harmonic(g, "TRADES"), "score")), f"{TRADES}{DIST} SELECT {BASE} + s AS id, round(coalesce(sum(1.0 / d) FILTER (WHERE d > 0), 0) / ((SELECT count(*) FROM v) - 1), 6) AS score FROM best GROUP BY s")
add("a_traverse", traded(lambda g: paths.traverse(g, BASE, "TRADES").select("id", F.col("depth").cast("long").alias("depth"))), f"{TRADES}{DIST} SELECT {BASE} + id AS id, CAST(d AS BIGINT) AS depth FROM best WHERE s = 0")
add("a_bfs_dist", traded(lambda g: paths.distances(g, g.nodes.select(F.col("id").alias("source")), "TRADES").select("source", "id", F.col("depth").cast("long").alias("depth"))), f"{TRADES}{DIST} SELECT {BASE} + s AS source, {BASE} + id AS id, CAST(d AS BIGINT) AS depth FROM best")
add("a_dijkstra_dist", traded(lambda g: six(paths.shortest_distances(g, BASE, "weight", "TRADES").select("id", "distance"), "distance")),
    f"{TRADES}, walk(id, d, n) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT b, min(d + w), any_value(n + 1) FROM walk JOIN e ON walk.id = e.a WHERE n < 24 GROUP BY b) SELECT {BASE} + id AS id, round(min(d), 6) AS distance FROM walk GROUP BY 1")
DENSE = TRADES.replace("r <= 3", "r <= 6")
add("a_simple_paths", traded(lambda g: _all_targets(g), 6),
    f"{DENSE}, p(v1, path) AS (SELECT 0, [0] UNION ALL SELECT b, list_append(path, b) FROM p JOIN e ON p.v1 = e.a WHERE len(path) < 5 AND NOT list_contains(path, b)) SELECT {BASE} + v1 AS goal, CAST(len(path) AS BIGINT) AS nodes, count(*) AS n FROM p WHERE v1 IN (SELECT b FROM e GROUP BY 1 ORDER BY count(*) DESC, b LIMIT 3) AND v1 <> 0 GROUP BY 1, 2")
add("a_bfs_path", traded(lambda g: _path_lengths(g), 6),
    f"{DENSE}{DIST} SELECT {BASE} + id AS goal, CAST(d AS BIGINT) AS steps FROM best WHERE s = 0 AND id IN (SELECT b FROM e GROUP BY 1 ORDER BY count(*) DESC, b LIMIT 3) AND id <> 0")


def _goals(g: PropertyGraph) -> list[int]:
    """The three nations that most trade goes to."""
    return [r.dst for r in g.rels.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(3).collect() if r.dst != BASE]


def _all_targets(g: PropertyGraph) -> DataFrame:
    out = None
    for goal in _goals(g):
        found = paths.simple_paths(g, BASE, goal, 4, type_="TRADES").groupBy(F.size("path").cast("long").alias("nodes")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(goal).cast("long").alias("goal"), "nodes", "n")
        out = found if out is None else out.unionByName(found)
    return out


def _path_lengths(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame([(goal, len(paths.bfs_path(g, BASE, goal, "TRADES")) - 1) for goal in _goals(g)], "goal long, steps long")


def _places(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers, nations and regions with their two types of relationships: a forest."""
    g = tables.load(spark, sf_dir, events=False)
    nodes = g.nodes.where(F.arrays_overlap("labels", F.array(F.lit("Customer"), F.lit("Nation"), F.lit("Region"))))
    return PropertyGraph.of(nodes, g.rels.where(F.col("type").isin("IN_NATION", "IN_REGION")), next_node=g.next_node, next_rel=g.next_rel).materialised()


add("a_wcc", lambda s, d: components.weakly_connected(_places(s, d)),
    f"WITH n AS (SELECT {STEP + 1} + r_regionkey AS id, r_regionkey AS c FROM region UNION ALL SELECT {2 * STEP + 1} + n_nationkey, n_regionkey FROM nation UNION ALL SELECT {3 * STEP + 1} + c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS component FROM n")
add("a_topo_level", lambda s, d: paths.topological_levels(_places(s, d)).select("id", F.col("level").cast("long").alias("level")),
    f"SELECT {3 * STEP + 1} + c_custkey AS id, CAST(0 AS BIGINT) AS level FROM customer UNION ALL SELECT {2 * STEP + 1} + n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 1 ELSE 0 END FROM nation UNION ALL SELECT {STEP + 1} + r_regionkey, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) THEN 2 WHEN r_regionkey IN (SELECT n_regionkey FROM nation) THEN 1 ELSE 0 END FROM region")
add("a_scc", traded(lambda g: components.strongly_connected(g, "TRADES")),
    f"{TRADES}, reach(s, id) AS (SELECT id, id FROM v UNION SELECT s, b FROM reach JOIN e ON reach.id = e.a), f AS (SELECT x.s AS id, min(x.id) AS c FROM reach x JOIN reach y ON x.s = y.id AND x.id = y.s GROUP BY 1) SELECT {BASE} + id AS id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS component FROM f")
TRI = ", t AS (SELECT p.x AS id, count(*) / 2 AS t FROM nb p JOIN nb q ON p.y = q.x JOIN nb r ON q.y = r.x AND r.y = p.x GROUP BY 1)"
add("a_triangles", traded(lambda g: structure.triangles(g, "TRADES")), f"{TRADES}{TRI} SELECT {BASE} + v.id AS id, CAST(coalesce(t, 0) AS BIGINT) AS triangles FROM v LEFT JOIN t USING (id)")
add("a_clustering", traded(lambda g: six(structure.clustering(g, "TRADES"), "coefficient")), f"{TRADES}{TRI} SELECT {BASE} + v.id AS id, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS coefficient FROM v LEFT JOIN k USING (id) LEFT JOIN t USING (id)")


def _pairs(g: PropertyGraph) -> DataFrame:
    x, y = g.nodes.select(F.col("id").alias("x")), g.nodes.select(F.col("id").alias("y"))
    return structure.pair_measures(g, x.join(y, F.col("x") < F.col("y")), "TRADES")


PAIRS = f"{TRADES}, q AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id < b.id), c AS (SELECT p.x, r.x AS y, count(*) AS c, sum(CASE WHEN k > 1 THEN 1 / ln(k) ELSE 0 END) AS aa, sum(1.0 / k) AS ra FROM nb p JOIN nb r ON p.y = r.y JOIN k ON k.id = p.y WHERE p.x < r.x GROUP BY 1, 2)"
for _n, _col, _sql in (("common_nbrs", "common", "coalesce(c, 0)"), ("total_nbrs", "total", "coalesce(i.k, 0) + coalesce(j.k, 0) - coalesce(c, 0)"), ("pref_attach", "preferential", "coalesce(i.k, 0) * coalesce(j.k, 0)"), ("adamic_adar", "adamic_adar", "round(coalesce(aa, 0), 6)"), ("resource_alloc", "resource_allocation", "round(coalesce(ra, 0), 6)")):
    add(f"a_{_n}", traded(lambda g, c=_col: (six(_pairs(g), c) if c in ("adamic_adar", "resource_allocation") else _pairs(g)).select("x", "y", c)),
        f"{PAIRS} SELECT {BASE} + q.x AS x, {BASE} + q.y AS y, {_sql} AS {_col} FROM q LEFT JOIN c ON c.x = q.x AND c.y = q.y LEFT JOIN k i ON i.id = q.x LEFT JOIN k j ON j.id = q.y")
KNN = "SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM (SELECT p.x, r.x AS y, count(*)::DOUBLE / (any_value(i.k) + any_value(j.k) - count(*)) AS s FROM nb p JOIN nb r ON p.y = r.y JOIN k i ON i.id = p.x JOIN k j ON j.id = r.x WHERE p.x <> r.x {where} GROUP BY 1, 2)"
for _n, _label, _where in (("a_knn", None, ""), ("a_knn_filtered", "Even", "AND r.x % 2 = 0")):
    add(_n, traded(lambda g, label=_label: six(structure.nearest_neighbours(PropertyGraph.of(g.nodes.withColumn("labels", F.when(F.col("id") % 2 == 1, F.array(F.lit("Even"))).otherwise(F.array().cast("array<string>"))), g.rels), 3, "TRADES", label=label), "score").select("id", "other", "score", F.col("rank").cast("long").alias("rank"))),
        f"{TRADES}, n AS ({KNN.format(where=_where)}) SELECT {BASE} + x AS id, {BASE} + y AS other, round(s, 6) AS score, r AS rank FROM n WHERE r <= 3")
add("a_mst_weight", traded(lambda g: structure.minimum_spanning_forest(g, "weight", "TRADES").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))),
    f"{TRADES}, t AS (SELECT a, b, w, a * 1000 + b AS k FROM e), c(k, x) AS (SELECT k, a FROM t UNION SELECT c.k, CASE WHEN l.a = c.x THEN l.b ELSE l.a END FROM c JOIN t ON t.k = c.k JOIN t l ON (l.a = c.x OR l.b = c.x) AND (l.w < t.w OR (l.w = t.w AND l.k < t.k))) SELECT count(*) AS edges, round(sum(w), 6) AS weight FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = t.k AND c.x = t.b)")
add("a_label_prop", traded(lambda g: components.label_propagation(g, "TRADES")))
add("a_louvain", traded(lambda g: components.louvain(g, "TRADES", 4)))
add("a_articulation", lambda s, d: structure.articulation_points(_places(s, d)),
    f"SELECT {2 * STEP + 1} + n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT {STEP + 1} + n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
add("a_bridges", lambda s, d: structure.bridges(_places(s, d)), f"SELECT {11 * STEP + 1} + n_nationkey AS id FROM nation UNION ALL SELECT {12 * STEP + 1} + c_custkey FROM customer")
add("a_max_flow", traded(lambda g: g.spark.createDataFrame([(goal, structure.max_flow(g, BASE, goal, "weight", "TRADES")) for goal in _goals(g)], "goal long, flow double"), 6))
add("a_random_walk", traded(lambda g: walks.random_walks(g, g.nodes.select(F.col("id").alias("start")), 6, "TRADES", seed=11).select("start", F.size("walk").alias("n"), F.array_join(F.transform("walk", lambda x: x.cast("string")), " ").alias("walk"))))

# vectors and embeddings


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


COSINE = "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query, x.vec_id AS id, round(list_cosine_similarity(q.e, x.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, x.embedding::DOUBLE[]), 12) DESC, x.vec_id) AS r FROM q JOIN embeddings x ON x.vec_id <> q.vec_id) SELECT query, id, score, r AS rank FROM s WHERE r <= 10"
add("v_cosine_topk", lambda s, d: six(vectors.cosine_search_all(_vectors(s, d), _vectors(s, d).where("id % 50 = 0"), 10).select("query", "id", "score", F.col("rank").cast("long").alias("rank")), "score"), COSINE)


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _vectors(spark, sf_dir)
    first = base.where("id = 0").first()
    query, dims = [float(x) for x in first["vector"]], len(first["vector"])
    return six(vectors.SignatureIndex(base, dims, seed=3).search(query, 10, base.count()), "score")


add("v_approx_topk", _signature, "SELECT vec_id AS id, round(list_cosine_similarity((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0), embedding::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0), embedding::DOUBLE[]) DESC, vec_id LIMIT 10")
def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _vectors(spark, sf_dir)
    dims = len(base.first()["vector"])
    found = vectors.SignatureIndex(base, dims, seed=3).search_all(base.where("id % 50 = 0"), 10)
    return six(found.select("query", "id", "score", F.col("rank").cast("long").alias("rank")), "score")


add("v_signature_topk", _signatures)
add("v_hnsw_topk", lambda s, d: six(vectors.HnswIndex(_vectors(s, d), 16, 100).search_all(_vectors(s, d).where("id % 50 = 0"), 10, 100), "score"))
add("v_flat_topk", lambda s, d: six(vectors.HnswIndex(_vectors(s, d), 16, 100, flat=True).search_all(_vectors(s, d).where("id % 50 = 0"), 10, 100, 8), "score"))


def _joined(df: DataFrame) -> DataFrame:
    """Vectors as text: arrays stay out of row hashes."""
    return df.select("id", F.array_join(F.transform("vector", lambda x: F.round(x, 6).cast("string")), " ").alias("vector"))


add("e_fastrp", traded(lambda g: _joined(embeddings.fastrp(g, 16, type_="TRADES", seed=5))))
add("e_node2vec", traded(lambda g: _joined(embeddings.node2vec(g, 16, 4, 2, 0.5, 2.0, type_="TRADES", seed=5))))


def _features(g: PropertyGraph) -> DataFrame:
    bit = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0
    return g.nodes.select("id", F.array(bit(1), bit(2), bit(3)).alias("features"), F.array(bit(4), bit(5)).alias("targets"))


def _trained(g: PropertyGraph) -> DataFrame:
    model = graphsage.Model.create(graphsage.Config(2, 3, 2, 4, True, 9))
    t = graphsage.train(g, model, _features(g), 5, 0.05, 8, 0.2, "mse", type_="TRADES")
    return g.spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(t.history)], "epoch long, train double, validation double")


add("e_graphsage_infer", traded(lambda g: _joined(graphsage.infer(g, graphsage.Model.create(graphsage.Config(2, 3, 4, 5, True, 9)), _features(g), "TRADES"))))
add("e_graphsage_train", traded(_trained))


# writes, over whole tables: what is read back from the graph that they make
def written(write: str, read: str, params: dict | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, _places(spark, sf_dir))
        db.query(write, params)
        return db.query(read, readonly=True, ordered=False).df

    return run


BY_NATION, BY_SEGMENT = "MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.name AS nation, count(c) AS n", "MATCH (c:Customer) RETURN c.segment AS segment, count(c) AS n"
add("w_create", written('MATCH (n:Nation) CREATE (n)-[:HAS {rank: 1}]->(t:Tag {name: n.name + "-tag"})', "MATCH (n:Nation)-[h:HAS]->(t:Tag) RETURN n.name AS nation, t.name AS tag, h.rank AS rank"), "SELECT n_name AS nation, n_name || '-tag' AS tag, CAST(1 AS BIGINT) AS rank FROM nation")
add("w_script", written('CREATE (a:Log {n: 1}); MATCH (a:Log) CREATE (a)-[:THEN]->(b:Log {n: a.n + 1}); MATCH (r:Region) MATCH (l:Log) CREATE (r)-[:SAW]->(l)', "MATCH (r:Region)-[:SAW]->(l:Log) RETURN r.name AS region, l.n AS n"), "SELECT r_name AS region, CAST(k AS BIGINT) AS n FROM region CROSS JOIN (VALUES (1), (2)) t(k)")
add("w_merge", written("MATCH (c:Customer) MERGE (s:Segment {name: c.segment}) MERGE (c)-[:OF]->(s)", "MATCH (c:Customer)-[:OF]->(s:Segment) RETURN s.name AS segment, count(c) AS n"), "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
add("w_merge_on", written("MATCH (c:Customer) MERGE (s:Segment {name: c.segment}) ON CREATE SET s.made = 1 ON MATCH SET s.again = true", "MATCH (s:Segment) RETURN s.name AS segment, s.made AS made, s.again AS again"), "SELECT c_mktsegment AS segment, CAST(1 AS BIGINT) AS made, CASE WHEN count(*) > 1 THEN true END AS again FROM customer GROUP BY 1")
add("w_set", written('MATCH (c:Customer) WHERE c.balance < 0 SET c.debt = -c.balance, c.segment = "DEBTOR"', 'MATCH (c:Customer {segment: "DEBTOR"}) RETURN c.name AS name, c.debt AS debt'), "SELECT c_name AS name, -c_acctbal AS debt FROM customer WHERE c_acctbal < 0")
add("w_set_merge", written("MATCH (n:Nation) SET n += {code: toLower(n.name), name: null}", "MATCH (n:Nation) RETURN n.code AS code, coalesce(n.name, \"none\") AS name"), "SELECT lower(n_name) AS code, 'none' AS name FROM nation")
add("w_set_replace", written("MATCH (r:Region) SET r = {title: r.name}", "MATCH (r:Region) RETURN r.title AS title, r.name IS NULL AS gone"), "SELECT r_name AS title, true AS gone FROM region")
add("w_remove", written("MATCH (c:Customer) WHERE c.balance > 5000 REMOVE c:Customer, c.segment", BY_SEGMENT), "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE NOT c_acctbal > 5000 GROUP BY 1")
add("w_delete", written("MATCH (c:Customer) WHERE c.balance < 0 DETACH DELETE c", BY_NATION), "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY 1")
add("w_delete_rels", written("MATCH (c:Customer)-[i:IN_NATION]->(n) WHERE c.balance < 0 DELETE i", BY_NATION), "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY 1")
add("w_aggregate", written("MATCH (c:Customer) WITH c.segment AS s, count(c) AS n CREATE (t:Total {segment: s, n: n})", "MATCH (t:Total) RETURN t.segment AS segment, t.n AS n"), "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether writes say that they changed something, and how many customers there are after each."""
    db, out = Database(spark, _places(spark, sf_dir)), []
    for text_ in ("MATCH (c:Customer) RETURN count(c)", 'MATCH (c:Missing) SET c.x = 1', "MATCH (r:Region) MERGE (s:Region {name: r.name})", "CREATE (c:Customer {name: \"new\"})"):
        changed = db.query(text_).mutated
        out.append((len(out), changed, db.query("MATCH (c:Customer) RETURN count(c) AS n").rows()[0][0]))
    return spark.createDataFrame(out, "step long, mutated boolean, customers long")


add("w_mutated", _mutated, "SELECT CAST(k AS BIGINT) AS step, k = 3 AS mutated, (SELECT count(*) FROM customer) + CASE WHEN k = 3 THEN 1 ELSE 0 END AS customers FROM range(4) t(k)")


def _crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's own calls: new nodes and relationships, changed and removed keys and labels."""
    g = _places(spark, sf_dir)
    first, rel = g.next_node, g.next_rel
    g = g.add_nodes([(["Port"], {"name": "north", "depth": 12}), (["Port"], {"name": "south"})]).add_rels([(first, "FERRY", first + 1, {"hours": 3}), (2 * STEP + 1, "HAS", first, {})])
    g = g.set_property("node", first + 1, "depth", 7).unset_property("node", first, "depth").add_label(first + 1, "Deep").set_property("rel", rel, "hours", 4)
    kept = g.nodes.where(F.array_contains("labels", "Port")).select("id", F.array_join("labels", ",").alias("labels"), F.col(P + "name").alias("name"), F.col(P + "depth").alias("depth"))
    ends = g.rels.where(F.col("type").isin("FERRY", "HAS")).groupBy(F.col("dst").alias("to")).agg(F.max(P + "hours").alias("hours"))
    return kept.join(ends, F.col("id") == F.col("to"), "left").drop("to")


add("w_crud", _crud, f"SELECT {10 * STEP} AS id, 'Port' AS labels, 'north' AS name, CAST(NULL AS BIGINT) AS depth, CAST(NULL AS BIGINT) AS hours UNION ALL SELECT {10 * STEP + 1}, 'Port,Deep', 'south', 7, 4")


# constraints, indexes, transactions, procedures
def _enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of writes that break constraints, and the customers that are left: as many as before."""
    from graphweft.errors import GraphError

    g = _places(spark, sf_dir)
    g = PropertyGraph.of(g.nodes.withColumn(P + "code", F.col("id")), g.rels, next_node=g.next_node, next_rel=g.next_rel)
    db, out = Database(spark, g), []
    db.create_constraint("unique", "Customer", "code")
    db.create_constraint("require", "Nation", "name")
    for text_ in ("MATCH (c:Customer) SET c.code = 7", "MATCH (n:Nation) REMOVE n.name", "MATCH (c:Customer) WHERE c.balance < 0 SET c.segment = \"x\""):
        try:
            db.query(text_)
            status = "OK"
        except GraphError as e:
            status = e.status
        out.append((status, db.query("MATCH (c:Customer) RETURN count(DISTINCT c.name) AS n").rows()[0][0]))
    return spark.createDataFrame(out, "status string, names long")


add("c_enforced", _enforced, "SELECT s AS status, (SELECT count(DISTINCT c_name) FROM customer) AS names FROM (VALUES ('EXISTS'), ('NOT_FOUND'), ('OK')) t(s)")


def _transacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, _places(spark, sf_dir))
    kept, dropped = db.begin(), db.begin()
    kept.query("MATCH (c:Customer) WHERE c.balance < 0 SET c.segment = \"DEBTOR\"")
    dropped.query("MATCH (c:Customer) SET c.segment = \"NONE\"")
    dropped.rollback()
    kept.commit()
    return db.query(BY_SEGMENT, readonly=True, ordered=False).df


add("c_transaction", _transacted, "SELECT CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the sizes that an index is asked for, all at once."""
    asked = spark.createDataFrame([(7,), (11,), (999,)], "wanted long")
    return tables.load(spark, sf_dir).build_index("Part", "size").lookup(asked, "wanted").select("wanted", "id")


add("c_index_lookup", _indexed, f"SELECT CAST(p_size AS BIGINT) AS wanted, {5 * STEP + 1} + p_partkey AS id FROM part WHERE p_size IN (7, 11, 999)")


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, tables.load(spark, sf_dir))
    db.register_procedure("around", lambda n: [(n - 1,), (n + 1,)], {"size": "int"})
    return db.query("MATCH (p:Part) WHERE p.size < 4 CALL around(p.size) YIELD size AS s RETURN p.name AS name, s", readonly=True, ordered=False).df


add("x_procedure", _called, "SELECT p_name AS name, CAST(p_size + k AS BIGINT) AS s FROM part CROSS JOIN (VALUES (-1), (1)) t(k) WHERE p_size < 4")


# sources and sinks: out to files and in again
def _fresh(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _named_places(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    g = _places(spark, sf_dir)
    return PropertyGraph.of(g.nodes.withColumn("ext", F.col("id").cast("string")), g.rels, next_node=g.next_node, next_rel=g.next_rel)


def _triples_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "triples")
    triples.export_triples(_named_places(spark, sf_dir), path)
    back = triples.import_triples(PropertyGraph.empty(spark), path).graph
    return triples.triples_of(back).groupBy("type", "target").agg(F.count_distinct("source").alias("n"))


add("io_triples", _triples_round, f"SELECT 'IN_NATION' AS type, CAST({2 * STEP + 1} + c_nationkey AS VARCHAR) AS target, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'IN_REGION', CAST({STEP + 1} + n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 2")


def _properties_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = _fresh(spark, "nodes"), _fresh(spark, "rels")
    property_files.export_property_graph(_named_places(spark, sf_dir), nodes, rels)
    db = Database(spark, property_files.import_property_graph(PropertyGraph.empty(spark), nodes, rels).graph)
    return db.query("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r) RETURN c.name AS name, c.balance AS balance, n.name AS nation, r.name AS region", readonly=True, ordered=False).df


PLACED = "SELECT c_name AS name, c_acctbal AS balance, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
add("io_properties", _properties_round, PLACED)


def _snapshot_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved twice (the second version is the current one), opened, sealed and unsealed."""
    at, sealed = _fresh(spark, "snapshot"), _fresh(spark, "sealed")
    db = Database(spark, _places(spark, sf_dir))
    snapshot.save(db.graph, at)
    db.query("MATCH (c:Customer) WHERE c.balance < 0 DETACH DELETE c")
    snapshot.save(db.graph, at)
    snapshot.encrypt(snapshot.load(spark, at), sealed, "a long password")
    opened = Database(spark, snapshot.decrypt(spark, sealed, "a long password"))
    return opened.query("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r) RETURN c.name AS name, c.balance AS balance, n.name AS nation, r.name AS region", readonly=True, ordered=False).df


add("io_snapshot", _snapshot_round, PLACED + " WHERE c_acctbal >= 0")
