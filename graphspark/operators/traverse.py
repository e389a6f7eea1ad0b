"""Multi-hop traversal: a specification becomes one DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.functions.props import all_of, plain
from graphspark.model import Graph
from graphspark.operators.aggregate import relationship_summary
from graphspark.operators.halfedges import half_edges
from graphspark.plans.scratch import stored
from graphspark.plans.traversal import Step, Traversal, checked

_HOP = "array<struct<edge:string,type:string,dir:string,id:string>>"


def _start(graph: Graph, spec: Traversal) -> DataFrame:
    v = graph.vertices
    if spec.start_id is not None:
        v = v.where(F.col("id") == spec.start_id)
    if spec.start_slug is not None:
        v = v.where(F.col("slug") == spec.start_slug)
    if spec.start_type is not None:
        v = v.where(F.col("type") == spec.start_type)
    if spec.start_filters:
        v = v.where(all_of(spec.start_filters, F.col("properties")))
    return v.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast(_HOP).alias("hops"))


def _targets(graph: Graph, step: Step) -> DataFrame | None:
    """Ids that a step may reach, or None for any vertex."""
    if graph.complete and not step.entity_types and not step.entity_filters:
        return None
    v = graph.vertices
    if step.entity_types:
        v = v.where(F.col("type").isin(*step.entity_types))
    if step.entity_filters:
        v = v.where(all_of(step.entity_filters, F.col("properties")))
    return v.select(F.col("id").alias("nxt"))


def _halves(graph: Graph, step: Step) -> DataFrame:
    edges = graph.edges
    if step.relationship_types:
        edges = edges.where(F.col("type").isin(*step.relationship_types))
    if step.relationship_filters:
        edges = edges.where(all_of(step.relationship_filters, F.col("properties")))
    return half_edges(edges, step.direction).select(F.col("a").alias("at"), F.col("b").alias("nxt"), "edge_id", F.col("type").alias("edge_type"), "dir")


def _walk(walks: DataFrame, halves: DataFrame, targets: DataFrame | None) -> DataFrame:
    """One hop; walks keep their multiplicity. Edges to vertices that don't exist are dropped."""
    grown = walks.join(halves, "at")
    if targets is not None:
        grown = grown.join(targets, "nxt", "left_semi")
    hop = F.struct(F.col("edge_id").alias("edge"), F.col("edge_type").alias("type"), "dir", F.col("nxt").alias("id"))
    return grown.select("start", F.col("nxt").alias("at"), F.array_append("hops", hop).alias("hops"))


def _repeat(graph: Graph, walks: DataFrame, step: Step, emit_all: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The walks after a repeated step, and those of each of its levels.

    A vertex is reached once, by the walk that arrives first (ties: the smallest path); the starting vertices count
    as reached. Walks that meet `until` stop; the result is the last level's continuing walks, those that all met it,
    or the starting walks if nothing was reached."""
    halves, targets = _halves(graph, step), _targets(graph, step)
    r = step.repeat
    levels, frontier, visited, result = [], walks, walks.select("at").distinct(), walks
    for _ in range(r.max_depth):
        new = _walk(frontier, halves, targets).join(visited, "at", "left_anti")
        # a minimum is combined before the shuffle, so a hub's many walks never meet
        rank = F.struct(F.transform("hops", lambda h: h["edge"]), "start")
        new = stored(new.groupBy("at").agg(F.min_by(F.struct("start", "hops"), rank).alias("w")).select("w.start", "at", "w.hops"), "walks")
        levels.append(new)
        if r.until or r.until_types:
            stop = graph.vertices
            if r.until_types:
                stop = stop.where(F.col("type").isin(*r.until_types))
            if r.until:
                stop = stop.where(all_of(r.until, F.col("properties")))
            going = new.join(stop.select(F.col("id").alias("at")), "at", "left_anti")
        else:
            going = new
        # reached something: go on with what continues, or else with what met the condition
        if new.isEmpty():
            break
        result = new if going is not new and going.isEmpty() else going
        visited = visited.unionByName(new.select("at").distinct())
        frontier = going
    return (reduce(DataFrame.unionByName, levels) if emit_all and levels else result), levels


def walks(graph: Graph, spec: Traversal) -> tuple[DataFrame, list[DataFrame]]:
    """The walks at the end (start, at, hops), and all walks at every depth, the start included."""
    at = _start(graph, checked(spec))
    depths = [at]
    for step in spec.steps:
        if step.repeat:
            at, levels = _repeat(graph, at, step, spec.emit_all)
            depths += levels if step.repeat.emit_intermediates else [at]
        else:
            at = _walk(at, _halves(graph, step), _targets(graph, step))
            depths.append(at)
    return at, depths


def terminal(graph: Graph, spec: Traversal) -> DataFrame:
    """The vertices at the ends, each once if spec.deduplicate."""
    ends, _ = walks(graph, spec)
    ids = ends.select(F.col("at").alias("id"))
    # an inner join: a semi-join would be pushed into each table of vertices, with the walk below it
    return graph.vertices.join(ids.distinct() if spec.deduplicate else ids, "id").select(graph.vertices.columns)


def projected(graph: Graph, spec: Traversal) -> DataFrame:
    """One row for each end vertex, each distinct combination, or each combination with its count; a missing value
    is null. Not paged."""
    p = spec.projection
    rows = terminal(graph, spec).select(*[plain(F.col("properties")[k]).alias(k) for k in p.properties])
    if p.mode == "distinct":
        return rows.distinct()
    if p.mode == "count":
        return rows.groupBy(*p.properties).agg(F.count(F.lit(1)).alias("count"))
    return rows


def path_rows(graph: Graph, spec: Traversal) -> DataFrame:
    """One row for each walk: start, vertex_path, edge_path and directions."""
    ends, _ = walks(graph, spec)
    part = lambda k: F.transform("hops", lambda h: h[k])
    return ends.select("start", F.concat(F.array("start"), part("id")).alias("vertex_path"), part("edge").alias("edge_path"), part("dir").alias("directions"))


def attached(graph: Graph, paths: DataFrame) -> DataFrame:
    """paths (vertex_path, edge_path) with `vertices` and `edges`: arrays of id, type and label, or id, type, source_id and
    target_id, in the order of the path; what doesn't exist has its id only."""
    rows = paths.withColumn("_key", F.to_json(F.struct("vertex_path", "edge_path")))
    out = rows
    for ids, frame, names, to in (("vertex_path", graph.vertices, ("type", "label"), "vertices"), ("edge_path", graph.edges, ("type", "source_id", "target_id"), "edges")):
        each = rows.select("_key", F.posexplode(ids).alias("_at", "id")).distinct()
        both = each.join(frame.select("id", *names), "id", "left")
        per = both.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", F.struct("id", *names).alias("x")))).alias("_x"))
        out = out.join(per.select("_key", F.transform("_x", lambda e: e["x"]).alias(to)), "_key", "left")
    return out.drop("_key")


def everything(graph: Graph, spec: Traversal) -> DataFrame:
    """Vertices and edges of all walks, each once: kind ("vertex" or "edge"), id and the first depth, in the order
    depth, vertices before edges, id."""
    _, depths = walks(graph, spec)
    parts = []
    for d, w in enumerate(depths):
        parts.append(w.select(F.lit("vertex").alias("kind"), F.col("at").alias("id"), F.lit(d).alias("depth")))
        if d:
            parts.append(w.select(F.lit("edge").alias("kind"), F.explode(F.transform("hops", lambda h: h["edge"])).alias("id"), F.lit(d).alias("depth")))
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "id").agg(F.min("depth").alias("depth"))


def page_of_everything(graph: Graph, spec: Traversal) -> tuple[DataFrame, DataFrame]:
    """The page's vertices and edges; ends of its edges that lie on other pages are filled in."""
    rows = everything(graph, spec)
    # a page's few rows are read three times: computed once
    page = stored(rows.orderBy("depth", F.desc("kind"), "id").offset(spec.offset).limit(spec.limit), "page")
    edges = graph.edges.join(page.where("kind = 'edge'").select("id"), "id", "left_semi")
    ids = page.where("kind = 'vertex'").select("id").union(edges.select("source_id")).union(edges.select("target_id")).distinct()
    return graph.vertices.join(ids, "id", "left_semi"), edges


def run(graph: Graph, spec: Traversal) -> DataFrame:
    """The specification's result as a frame: a projection, a page of vertices, of paths, or of everything."""
    if spec.projection:
        return projected(graph, spec)
    if spec.return_mode == "path":
        return path_rows(graph, spec).orderBy("vertex_path", "edge_path").offset(spec.offset).limit(spec.limit)
    if spec.return_mode == "all":
        return everything(graph, spec).orderBy("depth", F.desc("kind"), "id").offset(spec.offset).limit(spec.limit)
    return terminal(graph, spec).orderBy("id").offset(spec.offset).limit(spec.limit)


def with_relationship_summary(graph: Graph, vertices: DataFrame) -> DataFrame:
    """vertices with maps of their numbers of outgoing and incoming edges by type; empty maps for lonely ones."""
    counts = relationship_summary(graph, vertices)
    pairs = F.sort_array(F.collect_list(F.struct("type", "n")))
    per = counts.groupBy("id").pivot("direction", ["out", "in"]).agg(F.map_from_entries(pairs))
    both = vertices.join(per.withColumnsRenamed({"out": "outgoing", "in": "incoming"}), "id", "left")
    return both.withColumns({c: F.coalesce(c, F.create_map().cast("map<string,bigint>")) for c in ("outgoing", "incoming")})
