"""A property graph over a star schema's tables: region, nation, customer, supplier, part, orders, lineitem.

Vertices and edges are unions of plain projections; a filter on a type prunes the other tables from the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions.props import bag, empty_bag, number, text
from graphspark.model import BAG, Graph

# The tables' schemas; given, no file is opened to find them out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
VERTEX_TABLES = ("Region", "Nation", "Customer", "Supplier", "Part", "Order")


def _key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(col).cast("string"))


def _vertex(df: DataFrame, type_: str, key: str, label: Column, summary: Column, created: Column | None = None, **props: Column) -> DataFrame:
    id_ = _key(type_.lower(), key)
    stamp = F.lit(None).cast("string") if created is None else created
    return df.select(id_.alias("id"), F.lit(type_).alias("type"), label.alias("label"), summary.alias("summary"), (bag(**props) if props else empty_bag()).cast(BAG).alias("properties"), stamp.alias("created_at"))


def _edge(df: DataFrame, type_: str, id_: Column, source: Column, target: Column, both_ways: bool = False, **props: Column) -> DataFrame:
    return df.select(F.concat(F.lit(f"{type_}:"), id_).alias("id"), F.lit(type_).alias("type"), source.alias("source_id"), target.alias("target_id"), (bag(**props) if props else empty_bag()).cast(BAG).alias("properties"), F.lit(both_ways).alias("bidirectional"))


def star_graph(spark: SparkSession, folder: str, vertex_types: tuple[str, ...] = VERTEX_TABLES, edge_types: tuple[str, ...] | None = None) -> Graph:
    """The graph, or the part of it with the given types."""
    tables: dict[str, DataFrame] = {}

    def read(t: str) -> DataFrame:
        if t not in tables:
            tables[t] = spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}.parquet")
        return tables[t]

    none = F.lit(None).cast("string")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    vertices = {
        "Region": lambda: _vertex(read("region"), "Region", "r_regionkey", F.col("r_name"), none),
        "Nation": lambda: _vertex(read("nation"), "Nation", "n_nationkey", F.col("n_name"), none, regionkey=number(F.col("n_regionkey"))),
        "Customer": lambda: _vertex(read("customer"), "Customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment"), acctbal=number(F.col("c_acctbal")), segment=text(F.col("c_mktsegment")), nationkey=number(F.col("c_nationkey"))),
        "Supplier": lambda: _vertex(read("supplier"), "Supplier", "s_suppkey", F.col("s_name"), none, acctbal=number(F.col("s_acctbal")), nationkey=number(F.col("s_nationkey"))),
        "Part": lambda: _vertex(read("part"), "Part", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), brand=text(F.col("p_brand")), kind=text(F.col("p_type")), size=number(F.col("p_size")), price=number(F.col("p_retailprice"))),
        "Order": lambda: _vertex(read("orders"), "Order", "o_orderkey", _key("Order", "o_orderkey"), F.col("o_orderpriority"), day("o_orderdate"), status=text(F.col("o_orderstatus")), price=number(F.col("o_totalprice")), priority=text(F.col("o_orderpriority"))),
    }

    def trades() -> DataFrame:
        a, b = read("nation").alias("a"), read("nation").alias("b")
        pair = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
        return _edge(pair, "TRADES_WITH", F.concat_ws("-", "a.n_nationkey", "b.n_nationkey"), _key("nation", "a.n_nationkey"), _key("nation", "b.n_nationkey"), True)

    edges = {
        "IN_REGION": lambda: _edge(read("nation"), "IN_REGION", F.col("n_nationkey").cast("string"), _key("nation", "n_nationkey"), _key("region", "n_regionkey")),
        "IN_NATION": lambda: _edge(read("customer"), "IN_NATION", _key("c", "c_custkey"), _key("customer", "c_custkey"), _key("nation", "c_nationkey")).unionByName(_edge(read("supplier"), "IN_NATION", _key("s", "s_suppkey"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"))),
        "PLACED": lambda: _edge(read("orders"), "PLACED", F.col("o_orderkey").cast("string"), _key("customer", "o_custkey"), _key("order", "o_orderkey")),
        "CONTAINS": lambda: _edge(read("lineitem"), "CONTAINS", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _key("order", "l_orderkey"), _key("part", "l_partkey"), quantity=number(F.col("l_quantity")), discount=number(F.col("l_discount")), shipped=text(day("l_shipdate"))),
        "SUPPLIED_BY": lambda: _edge(read("lineitem").select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", F.concat_ws("-", "l_partkey", "l_suppkey"), _key("part", "l_partkey"), _key("supplier", "l_suppkey")),
        "TRADES_WITH": trades,
    }
    chosen = edges if edge_types is None else {k: edges[k] for k in edge_types}
    union = lambda parts: reduce(DataFrame.unionByName, [p() for p in parts])
    return Graph(union([vertices[t] for t in vertex_types]), union(list(chosen.values())), complete=set(vertex_types) == set(VERTEX_TABLES))


#: The same graph for DuckDB, as common table expressions.
SQL_VERTICES = """
V AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS label, CAST(NULL AS VARCHAR) AS summary FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', 'Order:' || o_orderkey, o_orderpriority FROM orders
)"""
SQL_EDGES = """
E AS (
  SELECT 'IN_REGION:' || n_nationkey AS id, 'IN_REGION' AS type, 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, false AS bidirectional FROM nation
  UNION ALL SELECT 'IN_NATION:c:' || c_custkey, 'IN_NATION', 'customer:' || c_custkey, 'nation:' || c_nationkey, false FROM customer
  UNION ALL SELECT 'IN_NATION:s:' || s_suppkey, 'IN_NATION', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, false FROM supplier
  UNION ALL SELECT 'PLACED:' || o_orderkey, 'PLACED', 'customer:' || o_custkey, 'order:' || o_orderkey, false FROM orders
  UNION ALL SELECT 'CONTAINS:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey, false FROM lineitem
  UNION ALL SELECT DISTINCT 'SUPPLIED_BY:' || l_partkey || '-' || l_suppkey, 'SUPPLIED_BY', 'part:' || l_partkey, 'supplier:' || l_suppkey, false FROM lineitem
  UNION ALL SELECT 'TRADES_WITH:' || a.n_nationkey || '-' || b.n_nationkey, 'TRADES_WITH', 'nation:' || a.n_nationkey, 'nation:' || b.n_nationkey, true FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
)"""
#: Directed half-edges: a bidirectional edge counts both ways, a self-loop once.
SQL_HALVES = """
H AS (
  SELECT source_id AS a, target_id AS b, id, type, 'out' AS dir, bidirectional FROM E
  UNION ALL SELECT target_id, source_id, id, type, 'in', bidirectional FROM E WHERE source_id <> target_id
)"""
