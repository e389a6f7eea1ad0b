"""Queries over the star schema's graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.functions.names import entity_slug
from graphspark.functions.props import Filter, all_of, bag, from_json, literal, plain
from graphspark.model import BAG, Graph
from graphspark.operators import aggregate, explore, mutate, read, scc, traverse
from graphspark.operators.halfedges import half_edges
from graphspark.plans.traversal import Projection, Repeat, Step, Traversal
from graphspark.sources.star_graph import SQL_EDGES, SQL_HALVES, SQL_VERTICES, star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_V, _VE, _VEH = f"WITH {SQL_VERTICES}", f"WITH {SQL_VERTICES}, {SQL_EDGES}", f"WITH RECURSIVE {SQL_VERTICES}, {SQL_EDGES}, {SQL_HALVES}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _brief(f: DataFrame) -> DataFrame:
    return f.select("id", "type", "label", "summary")


# --- scans and point reads ----------------------------------------------------------------------------------------


@query(f"{_V} SELECT id, type, label, summary FROM V WHERE type IN ('Customer', 'Supplier')")
def entity_scan_light(spark: SparkSession, d: str) -> DataFrame:
    return _brief(read.scan(star_graph(spark, d, ("Customer", "Supplier"), ("IN_NATION",)).vertices))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS label, 'Customer:' || lower(replace(c_name, '#', '-')) AS slug FROM customer WHERE c_custkey = 7")
def entity_by_slug(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Customer",), ("IN_NATION",)).vertices
    v = v.withColumn("slug", entity_slug(F.col("type"), F.col("label")))
    wanted = v.where("id = 'customer:7'").first()["slug"]
    return read.by_slug(v, wanted).select("id", "label", "slug")


@query(f"{_V} SELECT id, label FROM V WHERE id IN ('nation:1', 'nation:3', 'region:2', 'customer:11')")
def entities_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return read.by_ids(star_graph(spark, d, ("Region", "Nation", "Customer")).vertices, ["nation:1", "nation:3", "region:2", "customer:11", "nation:999"]).select("id", "label")


@query(f"{_VE} SELECT id, source_id, target_id FROM E WHERE id = 'IN_NATION:c:5' OR id = 'IN_NATION:c:customer:5'")
def relationship_by_id(spark: SparkSession, d: str) -> DataFrame:
    return read.by_id(star_graph(spark, d, ("Nation",), ("IN_NATION",)).edges, "IN_NATION:c:5").select("id", "source_id", "target_id")


@query("""WITH n AS (SELECT 'customer:' || c_custkey AS id, row_number() OVER (ORDER BY 'customer:' || c_custkey) - 1 AS r, count(*) OVER () AS c FROM customer)
SELECT id, CAST(r // 100 AS BIGINT) AS sequence, r // 100 = (c - 1) // 100 AS is_last FROM n""")
def export_chunks(spark: SparkSession, d: str) -> DataFrame:
    return read.chunks(star_graph(spark, d, ("Customer",), ("IN_NATION",)).vertices.select("id"), 100)


# --- find and filters ---------------------------------------------------------------------------------------------


@query(f"{_V} SELECT id, type, label, summary FROM V WHERE type = 'Customer' ORDER BY id LIMIT 25 OFFSET 50")
def find_by_type_page(spark: SparkSession, d: str) -> DataFrame:
    return _brief(read.find(star_graph(spark, d), 25, 50, types=["Customer"]).rows)


@query(f"{_V} SELECT id, type, label, summary FROM V WHERE contains(lower(label), 'mach') OR contains(lower(coalesce(summary, '')), 'mach')")
def find_by_term(spark: SparkSession, d: str) -> DataFrame:
    return _brief(read.matching(star_graph(spark, d).vertices, term="MACH"))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def find_by_property(spark: SparkSession, d: str) -> DataFrame:
    return read.matching(star_graph(spark, d).vertices, types=["Customer"], properties={"segment": "BUILDING", "nationkey": 3}).select("id", "label")


@query("SELECT 'event:' || event_id AS id, CAST(user_id AS VARCHAR) AS actor FROM events WHERE user_id IN (3, 5, 8) AND ts >= TIMESTAMP '2024-01-01' ")
def find_by_provenance(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    none = F.lit(None).cast("string")
    e = _table(spark, d, "events").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), F.struct(F.col("user_id").cast("string").alias("created_by"), none.alias("modified_by"), at.alias("created_at"), none.alias("modified_at"), none.alias("created_in_conversation"), none.alias("modified_in_conversation")).alias("provenance"))
    hit = read.ProvenanceFilter(actors=("3", "5", "8"), start="2024-01-01T00:00:00")
    return e.where(hit.on(F.col("provenance"))).select("id", F.col("provenance.created_by").alias("actor"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", from_json(F.col("props")).alias("properties"))


def _event_filter(name: str, f: Filter, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _events(spark, d).where(f.on(F.col("properties"))).select("event_id")

    run.__name__ = name
    query(f"WITH p AS (SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') AS t FROM events) SELECT event_id FROM p WHERE {sql}")(run)


_NUM = "t IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_event_filter("filter_eq", Filter("k", "eq", 42), f"{_NUM} AND CAST(k AS DOUBLE) = 42")
_event_filter("filter_neq_missing", Filter("absent", "neq", 1), "true")
_event_filter("filter_neq", Filter("k", "neq", 42), f"NOT coalesce({_NUM} AND CAST(k AS DOUBLE) = 42, false)")
_event_filter("filter_range_number", Filter("k", "gte", 90), f"{_NUM} AND CAST(k AS DOUBLE) >= 90")


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand > 'Brand#3' AND p_brand <= 'Brand#45'")
def filter_range_string(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)).vertices
    return v.where(all_of([Filter("brand", "gt", "Brand#3"), Filter("brand", "lte", "Brand#45")], F.col("properties"))).select("id")


@query("SELECT 'part:' || p_partkey AS id, 'Part' AS type, p_name AS label, p_brand || ' ' || p_type AS summary FROM part")
def detail_brief(spark: SparkSession, d: str) -> DataFrame:
    return read.detail(star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)).vertices, "brief")


@query("SELECT 'part:' || p_partkey AS id, p_name AS label, p_brand AS brand, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part")
def detail_summary(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    return read.detail(star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)).vertices, "summary").select("id", "label", p["brand"]["s"].alias("brand"), p["size"]["d"].alias("size"), p["price"]["d"].alias("price"))


# --- joins --------------------------------------------------------------------------------------------------------


@query(f"{_VE} SELECT e.id, coalesce(a.label, e.source_id) AS source_label, coalesce(b.label, e.target_id) AS target_label FROM E e LEFT JOIN V a ON a.id = e.source_id LEFT JOIN V b ON b.id = e.target_id WHERE e.type = 'IN_NATION'")
def enriched_relationships(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Nation", "Customer", "Supplier"), ("IN_NATION",))
    return read.enriched(g, g.edges).select("id", "source_label", "target_label")


@query(f"{_VE} SELECT id FROM E WHERE type = 'PLACED' AND source_id NOT IN (SELECT id FROM V WHERE type = 'Customer' AND summary <> 'BUILDING')")
def orphan_placements(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer",), ("PLACED",))
    some = g.vertices.where(F.col("summary") != "BUILDING").select(F.col("id").alias("source_id"))
    return g.edges.join(some, "source_id", "left_anti").select("id")


@query(f"{_VE} SELECT id FROM E WHERE source_id IN (SELECT id FROM V WHERE type IN ('Nation', 'Supplier')) AND target_id IN (SELECT id FROM V WHERE type IN ('Nation', 'Supplier'))")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, edge_types=("IN_REGION", "IN_NATION", "SUPPLIED_BY", "TRADES_WITH"))
    return read.induced(g, g.vertices.where(F.col("type").isin("Nation", "Supplier"))).select("id")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query(f"""{_VE}, s AS (SELECT 'entity' AS kind, type, count(*) AS n FROM V GROUP BY type UNION ALL SELECT 'relationship', type, count(*) FROM E GROUP BY type)
SELECT kind, type, CAST(n AS BIGINT) AS n FROM s UNION ALL SELECT kind, NULL, CAST(sum(n) AS BIGINT) FROM s GROUP BY kind""")
def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.statistics(star_graph(spark, d))


@query(f"""{_VE} SELECT id, direction, type, count(*) AS n FROM (SELECT source_id AS id, 'out' AS direction, type FROM E UNION ALL SELECT target_id, 'in', type FROM E) GROUP BY ALL""")
def relationship_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.relationship_summary(star_graph(spark, d))


@query(f"{_VE} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM E UNION ALL SELECT target_id FROM E) GROUP BY id")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.degrees(star_graph(spark, d))


@query(f"{_VE}, g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM E UNION ALL SELECT target_id FROM E) GROUP BY id ORDER BY degree DESC, id LIMIT 20) SELECT g.id, degree, type, label FROM g JOIN V ON V.id = g.id")
def hubs_topk(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.hubs(star_graph(spark, d), 20)


@query(f"{_VE}, g AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM E UNION ALL SELECT target_id FROM E) GROUP BY id) SELECT V.id, V.type, V.label, CAST(coalesce(n, 0) AS BIGINT) AS degree FROM V LEFT JOIN g ON V.id = g.id WHERE V.type IN ('Customer', 'Nation', 'Region')")
def viewer_payload(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.viewer_rows(star_graph(spark, d)).where(F.col("type").isin("Customer", "Nation", "Region"))


@query("SELECT 'part:' || l_partkey AS id, count(DISTINCT l_orderkey) AS importers FROM lineitem GROUP BY l_partkey ORDER BY importers DESC, id LIMIT 10")
def importer_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.importer_counts(star_graph(spark, d, ("Part",), ("CONTAINS",)), "CONTAINS", 10)


_PARTS = Traversal(start_type="Part", projection=Projection(("brand", "kind")))


@query("SELECT p_brand AS brand, p_type AS kind FROM part")
def projection_values(spark: SparkSession, d: str) -> DataFrame:
    return traverse.run(star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)), _PARTS)


@query("SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part")
def projection_distinct(spark: SparkSession, d: str) -> DataFrame:
    return traverse.run(star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)), Traversal(start_type="Part", projection=Projection(("brand", "kind"), "distinct")))


@query("SELECT p_brand AS brand, CAST(NULL AS VARCHAR) AS nothing, count(*) AS count FROM part GROUP BY p_brand")
def projection_count(spark: SparkSession, d: str) -> DataFrame:
    return traverse.run(star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)), Traversal(start_type="Part", projection=Projection(("brand", "nothing"), "count")))


# --- half-edges and neighbourhoods ----------------------------------------------------------------------------------


@query(f"{_VE} SELECT id FROM E WHERE source_id = 'nation:3' OR (bidirectional AND target_id = 'nation:3')")
def rels_out(spark: SparkSession, d: str) -> DataFrame:
    return read.relationships(star_graph(spark, d), "nation:3", "out").select("id")


@query(f"{_VE} SELECT id FROM E WHERE target_id = 'nation:3' OR (bidirectional AND source_id = 'nation:3')")
def rels_in(spark: SparkSession, d: str) -> DataFrame:
    return read.relationships(star_graph(spark, d), "nation:3", "in").select("id")


@query(f"{_VE} SELECT id FROM E WHERE type = 'TRADES_WITH' AND (source_id = 'nation:3' OR target_id = 'nation:3')")
def rels_both_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return read.relationships(star_graph(spark, d), "nation:3", "both", ["TRADES_WITH"]).select("id")


@query(f"{_VEH} SELECT a, b, id AS edge_id, dir FROM H WHERE (dir = 'out' OR bidirectional) AND type IN ('TRADES_WITH', 'IN_REGION')")
def half_edges_out(spark: SparkSession, d: str) -> DataFrame:
    return half_edges(star_graph(spark, d, ("Nation",), ("TRADES_WITH", "IN_REGION")).edges, "out").select("a", "b", "edge_id", "dir")


@query(f"{_VE} SELECT DISTINCT id FROM E WHERE source_id IN (SELECT id FROM V WHERE type = 'Region') OR target_id IN (SELECT id FROM V WHERE type = 'Region')")
def rels_batch(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, edge_types=("IN_REGION", "TRADES_WITH"))
    return read.relationships_of(g, g.vertices.where("type = 'Region'")).select("id")


def _layers_sql(start: str, depth: int, types: str = "", entity: str = "", only_out: bool = False) -> str:
    held = "TRUE" + (f" AND H.type IN ({types})" if types else "") + (" AND (H.dir = 'out' OR H.bidirectional)" if only_out else "")
    allowed = f" AND V.type IN ({entity})" if entity else ""
    parts, seen = [], f"SELECT '{start}' AS id"
    for k in range(1, depth + 1):
        source = f"SELECT '{start}' AS id" if k == 1 else f"SELECT DISTINCT id FROM L{k - 1}"
        parts.append(f"L{k} AS (SELECT DISTINCT {k} AS depth, H.type AS relationship_type, V.id, V.type, V.label FROM ({source}) f JOIN H ON H.a = f.id JOIN V ON V.id = H.b WHERE {held}{allowed} AND H.b NOT IN ({seen}))")
        seen += f" UNION ALL SELECT id FROM L{k}"
    return f"{_VEH}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM L{k}" for k in range(1, depth + 1))


@query(_layers_sql("nation:3", 1))
def explore_d1(spark: SparkSession, d: str) -> DataFrame:
    return explore.layers(star_graph(spark, d), "nation:3", 1)


@query(_layers_sql("nation:3", 2))
def explore_d2(spark: SparkSession, d: str) -> DataFrame:
    return explore.layers(star_graph(spark, d), "nation:3", 2)


@query(_layers_sql("customer:7", 3, "'PLACED', 'CONTAINS', 'SUPPLIED_BY'", only_out=True))
def explore_d3(spark: SparkSession, d: str) -> DataFrame:
    return explore.layers(star_graph(spark, d), "customer:7", 3, "out", ["PLACED", "CONTAINS", "SUPPLIED_BY"])


@query(_layers_sql("region:1", 2, "'IN_REGION', 'IN_NATION'", "'Nation', 'Supplier'"))
def explore_filtered(spark: SparkSession, d: str) -> DataFrame:
    return explore.layers(star_graph(spark, d), "region:1", 2, "both", ["IN_REGION", "IN_NATION"], ["Nation", "Supplier"])


@query(_layers_sql("nation:8", 2, "'TRADES_WITH'", only_out=True))
def explore_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return explore.layers(star_graph(spark, d, ("Nation",), ("TRADES_WITH",)), "nation:8", 2, "out")


@query(f"WITH l AS ({_layers_sql('nation:3', 2)}), r AS (SELECT *, count(*) OVER (PARTITION BY depth, relationship_type) AS total, row_number() OVER (PARTITION BY depth, relationship_type ORDER BY id) AS p FROM l) SELECT depth, relationship_type, id, type, label, total FROM r WHERE p > 2 AND p <= 7")
def per_type_limit(spark: SparkSession, d: str) -> DataFrame:
    return explore.explore(star_graph(spark, d), "nation:3", 2, 5, 2)


@query(f"WITH l AS ({_layers_sql('nation:3', 2)}) SELECT depth, relationship_type, count(*) AS total, least(count(*), 5) AS returned, count(*) > 5 AS truncated FROM l GROUP BY depth, relationship_type")
def explore_statistics(spark: SparkSession, d: str) -> DataFrame:
    return explore.explore_statistics(explore.layers(star_graph(spark, d), "nation:3", 2), 5)


@query("SELECT *, 25 AS page_size, (SELECT count(*) FROM customer) AS total FROM (SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY id LIMIT 25 OFFSET 25)")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    p = read.find(star_graph(spark, d, ("Customer",), ("IN_NATION",)), 25, 25)
    return p.rows.select("id", F.lit(25).alias("page_size"), F.lit(p.total).cast("long").alias("total"))


# --- paths ----------------------------------------------------------------------------------------------------------


def _paths_sql(source: str, target: str, depth: int, types: str, pruned: bool) -> str:
    """All simple paths by recursion; pruned ones have each middle vertex at its own distance from the source."""
    simple = f"""P AS (
      SELECT H.b AS loc, ['{source}', H.b] AS vs, [H.id] AS es, [H.dir] AS ds FROM H WHERE H.a = '{source}' AND H.type IN ({types}) AND H.b <> '{source}'
      UNION ALL SELECT H.b, list_append(vs, H.b), list_append(es, H.id), list_append(ds, H.dir) FROM P JOIN H ON H.a = P.loc
      WHERE H.type IN ({types}) AND P.loc <> '{target}' AND NOT list_contains(vs, H.b) AND len(es) < {depth})"""
    if not pruned:
        keep = "TRUE"
        extra = ""
    else:
        extra = ", D AS (SELECT loc, min(len(es)) AS dist FROM P GROUP BY loc), X AS (SELECT P.es, bool_and(D.dist = u.i) AS fine FROM P, unnest(range(1, len(P.es))) AS u(i), D WHERE D.loc = P.vs[u.i + 1] AND P.loc = '" + target + "' GROUP BY P.es)"
        keep = "(len(es) = 1 OR es IN (SELECT es FROM X WHERE fine))"
    return f"{_VEH}, {simple}{extra} SELECT CAST(len(es) AS INTEGER) AS hops, array_to_string(vs, '>') AS vertices, array_to_string(es, '>') AS edges, array_to_string(ds, '>') AS directions FROM P WHERE loc = '{target}' AND {keep}"


def _path_rows(p: DataFrame) -> DataFrame:
    return p.select("hops", F.array_join("vertex_path", ">").alias("vertices"), F.array_join("edge_path", ">").alias("edges"), F.array_join("directions", ">").alias("directions"))


@query(_paths_sql("nation:3", "nation:8", 3, "'IN_REGION', 'TRADES_WITH'", True))
def paths_bfs_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _path_rows(explore.paths(star_graph(spark, d, ("Nation", "Region"), ("IN_REGION", "TRADES_WITH")), "nation:3", "nation:8", 3))


@query(_paths_sql("nation:3", "nation:8", 3, "'IN_REGION', 'TRADES_WITH'", False))
def paths_all_simple(spark: SparkSession, d: str) -> DataFrame:
    return _path_rows(explore.paths(star_graph(spark, d, ("Nation", "Region"), ("IN_REGION", "TRADES_WITH")), "nation:3", "nation:8", 3, "all_simple"))


@query(_paths_sql("customer:3", "supplier:0", 4, "'IN_NATION', 'IN_REGION'", False))
def paths_typed(spark: SparkSession, d: str) -> DataFrame:
    return _path_rows(explore.paths(star_graph(spark, d), "customer:3", "supplier:0", 4, "all_simple", ["IN_NATION", "IN_REGION"], ["Nation", "Region"]))


# --- traversal ------------------------------------------------------------------------------------------------------


@query("SELECT 'order:' || o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey = 7")
def traverse_one_hop(spark: SparkSession, d: str) -> DataFrame:
    out = traverse.terminal(star_graph(spark, d), Traversal(start_id="customer:7", steps=(Step("out", ("PLACED",)),)))
    return out.select("id", plain(F.col("properties")["status"]).alias("status"))


@query("SELECT DISTINCT 'part:' || l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def traverse_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return traverse.terminal(star_graph(spark, d), Traversal(start_id="customer:7", steps=(Step("out", ("PLACED",)), Step("out", ("CONTAINS",))))).select("id")


@query("SELECT DISTINCT 'part:' || l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 AND l_quantity >= 40")
def traverse_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    steps = (Step("out", ("PLACED",)), Step("out", ("CONTAINS",), relationship_filters=(Filter("quantity", "gte", 40),)))
    return traverse.terminal(star_graph(spark, d), Traversal(start_id="customer:7", steps=steps)).select("id")


@query("SELECT DISTINCT 'order:' || o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_totalprice > 300000")
def traverse_vertex_filter(spark: SparkSession, d: str) -> DataFrame:
    steps = (Step("in", ("IN_NATION",), ("Customer",)), Step("out", ("PLACED",), entity_filters=(Filter("price", "gt", 300000),)))
    return traverse.terminal(star_graph(spark, d), Traversal(start_id="nation:3", steps=steps)).select("id")


@query("SELECT p_brand AS brand, count(*) AS count FROM (SELECT DISTINCT p_partkey, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING') GROUP BY p_brand")
def traverse_count(spark: SparkSession, d: str) -> DataFrame:
    spec = Traversal(start_type="Customer", start_filters=(Filter("segment", "eq", "BUILDING"),), steps=(Step("out", ("PLACED",)), Step("out", ("CONTAINS",))), projection=Projection(("brand",), "count"))
    return traverse.run(star_graph(spark, d), spec)


@query("SELECT 'customer:7>order:' || o_orderkey || '>part:' || l_partkey AS vertices, 'PLACED:' || o_orderkey || '>CONTAINS:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edges, 'out>out' AS directions FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def traverse_paths(spark: SparkSession, d: str) -> DataFrame:
    p = traverse.path_rows(star_graph(spark, d), Traversal(start_id="customer:7", steps=(Step("out", ("PLACED",)), Step("out", ("CONTAINS",))), return_mode="path"))
    return p.select(F.array_join("vertex_path", ">").alias("vertices"), F.array_join("edge_path", ">").alias("edges"), F.array_join("directions", ">").alias("directions"))


@query(f"""{_VE}, o AS (SELECT * FROM E WHERE type = 'PLACED' AND source_id = 'customer:7'), l AS (SELECT E.* FROM E JOIN o ON E.source_id = o.target_id WHERE E.type = 'CONTAINS')
SELECT 'vertex' AS kind, 'customer:7' AS id, 0 AS depth UNION ALL SELECT DISTINCT 'vertex', target_id, 1 FROM o UNION ALL SELECT DISTINCT 'edge', id, 1 FROM o UNION ALL SELECT DISTINCT 'vertex', target_id, 2 FROM l UNION ALL SELECT DISTINCT 'edge', id, 2 FROM l""")
def traverse_all_union(spark: SparkSession, d: str) -> DataFrame:
    return traverse.everything(star_graph(spark, d), Traversal(start_id="customer:7", steps=(Step("out", ("PLACED",)), Step("out", ("CONTAINS",))), return_mode="all"))


@query("SELECT 'nation:' || b.n_nationkey AS id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 8 AND b.n_nationkey <> 8")
def traverse_repeat(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Nation", "Region"), ("TRADES_WITH", "IN_REGION"))
    return traverse.terminal(g, Traversal(start_id="nation:8", steps=(Step("out", ("TRADES_WITH",), repeat=Repeat(2)),))).select("id")


@query("SELECT 'region:' || n_regionkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def traverse_repeat_until(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer", "Nation", "Region"), ("IN_NATION", "IN_REGION"))
    return traverse.terminal(g, Traversal(start_id="customer:7", steps=(Step("out", (), repeat=Repeat(3, until_types=("Region",))),))).select("id")


@query(None)
def components_of_trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations trading in a ring within a region: each region is one component; the edge to the next region makes no
    cycle."""
    n = _table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    nxt = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    ring = n.withColumn("nxt", nxt).join(first, "n_regionkey").select(F.col("n_nationkey").alias("source_id"), F.coalesce("nxt", "first").alias("target_id"))
    over = first.alias("a").join(first.alias("b"), F.col("a.n_regionkey") + 1 == F.col("b.n_regionkey")).select(F.col("a.first").alias("source_id"), F.col("b.first").alias("target_id"))
    return scc.strongly_connected(ring.union(over))


SQL["components_of_trade"] = "SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation"


# --- mutations ------------------------------------------------------------------------------------------------------


def _incoming(g: Graph) -> DataFrame:
    """Every third customer under its own id with a new label, and as many new ones."""
    n = F.expr("cast(substring(id, 10) as long)")
    old = g.vertices.where(n % 3 == 0).withColumn("label", F.concat("label", F.lit(" (new)")))
    return old.unionByName(g.vertices.where(n % 3 == 1).withColumn("id", F.concat("id", F.lit("x"))))


def _merge(name: str, policy: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = star_graph(spark, d, ("Customer",), ("PLACED",))
        return mutate.merge_vertices(g, _incoming(g), policy)[0].select("id", "label")

    run.__name__ = name
    query(f"WITH c AS (SELECT c_custkey AS k, 'customer:' || c_custkey AS id, c_name AS label FROM customer) {sql}")(run)


_ADDED = "UNION ALL SELECT id || 'x', label FROM c WHERE k % 3 = 1"
_merge("import_merge_skip", "skip", f"SELECT id, label FROM c {_ADDED}")
_merge("import_merge_overwrite", "overwrite", f"SELECT id, CASE WHEN k % 3 = 0 THEN label || ' (new)' ELSE label END AS label FROM c {_ADDED}")
_merge("import_merge_rename", "rename", f"SELECT id, label FROM c {_ADDED} UNION ALL SELECT id || '-imported', label || ' (new)' FROM c WHERE k % 3 = 0")


@query(f"{_VE} SELECT id FROM E WHERE type IN ('PLACED', 'IN_NATION') AND source_id NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer", "Supplier"), ("PLACED", "IN_NATION"))
    return mutate.delete_vertices(g, g.vertices.where("summary = 'BUILDING'").select("id")).edges.select("id")


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'gold' END AS tier FROM customer")
def merge_patch(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Customer",), ("PLACED",)).vertices
    even = F.expr("cast(substring(id, 10) as long) % 2 = 0")
    patch = F.when(even, bag(segment=literal(None), tier=literal("gold")).cast(BAG)).otherwise(F.create_map().cast(BAG))
    p = mutate.merge_patch(F.col("properties"), patch)
    return v.select("id", p["segment"]["s"].alias("segment"), p["tier"]["s"].alias("tier"))


@query("SELECT 'order:' || l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS wave FROM lineitem")
def import_waves(spark: SparkSession, d: str) -> DataFrame:
    l = _table(spark, d, "lineitem")  # noqa: E741
    return mutate.import_waves(l.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))).select("id", "wave")
