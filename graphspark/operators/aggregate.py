"""Counts over a graph: statistics, relationship summaries, degrees, hubs, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.model import Graph


def statistics(graph: Graph) -> DataFrame:
    """kind (entity or relationship), type and n; type null is the total."""
    parts = [f.groupBy(F.lit(k).alias("kind"), "type").agg(F.count(F.lit(1)).alias("n")) for k, f in (("entity", graph.vertices), ("relationship", graph.edges))]
    both = parts[0].unionByName(parts[1])
    return both.unionByName(both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit(None).cast("string").alias("type"), "n"))


def relationship_summary(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """id, direction, type and n by stored direction; a self-loop counts on both sides. All vertices, or ids."""
    e = graph.edges
    halves = e.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "type").unionByName(e.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "type"))
    if ids is not None:
        halves = halves.join(ids.select("id").distinct(), "id", "left_semi")
    return halves.groupBy("id", "direction", "type").agg(F.count(F.lit(1)).alias("n"))


def degrees(graph: Graph) -> DataFrame:
    """id and degree (ends of edges) of each vertex that has edges."""
    ends = graph.edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(graph: Graph, k: int = 10) -> DataFrame:
    """The k vertices (1 to 50) with the highest degree; ties by id."""
    top = degrees(graph).orderBy(F.desc("degree"), "id").limit(max(1, min(50, k)))
    return top.join(graph.vertices.select("id", "type", "label"), "id")


def hub_graph(graph: Graph, k: int = 25) -> Graph:
    """The k hubs (id, type, label, degree) and the edges with both ends among them."""
    top = hubs(graph, k)
    ids = top.select(F.col("id").alias("_v"))
    near = graph.edges.join(F.broadcast(ids), F.col("source_id") == F.col("_v"), "left_semi")
    return Graph(top, near.join(F.broadcast(ids), F.col("target_id") == F.col("_v"), "left_semi"))


def viewer_rows(graph: Graph) -> DataFrame:
    """Vertices with their degree, 0 for lonely ones."""
    return graph.vertices.select("id", "type", "label").join(degrees(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def importer_counts(graph: Graph, edge_type: str, k: int = 10) -> DataFrame:
    """The k targets with the most distinct sources over an edge type; ties by id."""
    return graph.edges.where(F.col("type") == edge_type).groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("importers")).orderBy(F.desc("importers"), "id").limit(k)
