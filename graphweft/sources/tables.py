"""The star-schema tables as a property graph.

Nodes and relationships are unions of table scans with constant labels and types. A label or type filter folds to
false on the other branches, so Catalyst prunes whole tables, and columns, from any query.

Ids are code * 10 ** 12 + key + 1.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.graph import P, PropertyGraph, Shape

CODE = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "EventType": 8, "Event": 9}
STEP = 10**12
#: Hashed ids of event types stay below this.
HASHED = 10**9


def ident(label: str, key: str | Column) -> Column:
    return (F.lit(CODE[label] * STEP + 1) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def named(text: str | Column) -> Column:
    """Key of an entity that has a name only."""
    return F.pmod(F.xxhash64(text), F.lit(HASHED))


def load(spark: SparkSession, sf_dir: str, events: bool = True) -> PropertyGraph:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    made: dict[str, tuple[DataFrame, list[Column]]] = {}
    ends: dict[str, tuple[str, str]] = {}
    owned: dict[str, tuple[str, DataFrame]] = {}

    def node(df: DataFrame, label: str, key: str | Column, props: dict[str, str | Column]) -> DataFrame:
        columns = [ident(label, key).alias("id"), F.array(F.lit(label)).alias("labels"), *[(F.col(c) if isinstance(c, str) else c).alias(P + k) for k, c in props.items()]]
        made[label] = (df, columns)
        return df.select(*columns)

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    nation, customer, supplier, orders, lines = (table(t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    nodes = [
        node(table("region"), "Region", "r_regionkey", {"name": "r_name"}),
        node(nation, "Nation", "n_nationkey", {"name": "n_name"}),
        node(customer, "Customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
        node(supplier, "Supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
        node(table("part"), "Part", "p_partkey", {"name": "p_name", "brand": "p_brand", "size": F.col("p_size").cast("long"), "price": "p_retailprice"}),
        node(orders, "Order", "o_orderkey", {"status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority", "date": micros("o_orderdate")}),
    ]

    def rel(df: DataFrame, code: int, key: Column, type_: str, src: tuple[str, str | Column], dst: tuple[str, str | Column], props: dict[str, Column] | None = None) -> DataFrame:
        ends[type_] = (src[0], dst[0])
        columns = [(F.lit(code * STEP + 1) + key).cast("long").alias("id"), ident(*src).alias("src"), ident(*dst).alias("dst"), F.lit(type_).alias("type"), *[c.alias(P + k) for k, c in (props or {}).items()]]
        for end, label in (("src", src[0]), ("dst", dst[0])):
            if made[label][0] is df:  # the node's own row
                own = df.select(*[c.alias("own_" + name) for c, name in zip(made[label][1], df.select(*made[label][1]).columns, strict=True)], *columns)
                owned[type_] = (end, own)
        return df.select(*columns)

    # (order, line number) repeats: lines are numbered inside their order, never over the whole table, and only where
    # a query asks for ids; equal pairs go by a hash of the row
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.xxhash64(*lines.columns))) - 1
    numbered = lines.withColumn("line", line)
    rels = [
        rel(nation, 11, F.col("n_nationkey"), "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        rel(customer, 12, F.col("c_custkey"), "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        rel(supplier, 13, F.col("s_suppkey"), "BASED_IN", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        rel(orders, 14, F.col("o_orderkey"), "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), {"price": F.col("o_totalprice"), "date": micros("o_orderdate")}),
        rel(numbered, 15, F.col("l_orderkey") * 1000 + F.col("line"), "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount")}),
        rel(numbered, 16, F.col("l_orderkey") * 1000 + F.col("line"), "SUPPLIED_BY", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), {"quantity": F.col("l_quantity")}),
    ]
    if events:
        ev = table("events")
        nodes.append(node(ev.select("user_id").distinct(), "User", "user_id", {"key": "user_id"}))
        nodes.append(node(ev.select("event_type").distinct(), "EventType", named("event_type"), {"name": "event_type"}))
        nodes.append(node(ev, "Event", "event_id", {"value": "value", "ts": micros("ts")}))
        rels.append(rel(ev, 17, F.col("event_id"), "PERFORMED", ("User", "user_id"), ("EventType", named("event_type")), {"value": F.col("value"), "ts": micros("ts")}))
        after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        rels.append(rel(ev.withColumn("after", after).where("after is not null"), 18, F.col("event_id"), "NEXT", ("Event", "event_id"), ("Event", "after")))

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    graph = PropertyGraph.of(together(nodes), together(rels), next_node=10 * STEP, next_rel=20 * STEP)

    def whole(wide: DataFrame) -> DataFrame:
        """With a column for each key of the graph, null where the label or type lacks it."""
        missing = {h + f.name: F.lit(None).cast(f.dataType) for h, df in (("own_", graph.nodes), ("", graph.rels)) for f in df.schema.fields if f.name.startswith(P) and h + f.name not in wide.columns}
        return wide.withColumns(missing) if missing else wide

    return replace(graph, shape=Shape(graph.nodes, graph.rels, ends, {t: (end, whole(wide)) for t, (end, wide) in owned.items()}))


def trades(spark: SparkSession, sf_dir: str, heaviest: int = 3) -> PropertyGraph:
    """Nations, and TRADES from customers' to suppliers' nations: the heaviest by quantity, without loops."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nation = table("nation")
    # sums first: two small keys meet the fact table before any name does
    flow = (
        table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("a <> b").groupBy("a", "b").agg(F.sum("l_quantity").alias("weight"))
    )
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    kept = flow.withColumn("rank", rank).where(F.col("rank") <= heaviest)
    nodes = nation.select(ident("Nation", "n_nationkey").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.col("n_name").alias(P + "name"))
    rels = kept.select((F.col("a") * 1000 + F.col("b") + 1).cast("long").alias("id"), ident("Nation", "a").alias("src"), ident("Nation", "b").alias("dst"), F.lit("TRADES").alias("type"), F.col("weight").alias(P + "weight"))
    return PropertyGraph.of(nodes, rels, next_node=3 * STEP, next_rel=STEP)
