"""What happened to a vertex: its creation, changes and incident relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.model import Graph, Page
from graphspark.operators.read import ProvenanceFilter, page

EVENTS = ("entity_created", "entity_updated", "relationship_created")


def events(graph: Graph, id_: str, start: str | None = None, end: str | None = None, kinds: tuple[str, ...] = (), provenance: ProvenanceFilter | None = None) -> DataFrame:
    """event, at, object_id and other_id. Frames need provenance; times are ISO texts, bounds inclusive; a change
    counts only if it is later than the creation; a self-loop counts once. An unknown vertex is an error."""
    me = graph.vertices.where(F.col("id") == id_)
    if me.isEmpty():
        raise KeyError(id_)
    p = F.col("provenance")
    row = lambda kind, at, other: (F.lit(kind).alias("event"), at.alias("at"), F.col("id").alias("object_id"), other.alias("other_id"), p.alias("provenance"))
    none = F.lit(None).cast("string")
    created = me.select(*row("entity_created", p["created_at"], none))
    updated = me.where(p["modified_at"].isNotNull() & (p["modified_at"] != p["created_at"])).select(*row("entity_updated", p["modified_at"], none))
    mine = graph.edges.where((F.col("source_id") == id_) | (F.col("target_id") == id_))
    tied = mine.select(*row("relationship_created", p["created_at"], F.when(F.col("source_id") == id_, F.col("target_id")).otherwise(F.col("source_id"))))
    out = created.unionByName(updated).unionByName(tied)
    if start is not None:
        out = out.where(F.col("at") >= start)
    if end is not None:
        out = out.where(F.col("at") <= end)
    if kinds:
        out = out.where(F.col("event").isin(*kinds))
    if provenance is not None:
        out = out.where(provenance.on(p))
    return out.drop("provenance")


def described(graph: Graph, found: DataFrame) -> DataFrame:
    """events() with a sentence for each, naming the vertices by label."""
    label = graph.vertices.select(F.col("id").alias("other_id"), F.col("label").alias("other_label"))
    kind = graph.edges.select(F.col("id").alias("object_id"), F.col("type").alias("edge_type"))
    both = found.join(label, "other_id", "left").join(kind, "object_id", "left")
    said = F.when(F.col("event") == "entity_created", "created").when(F.col("event") == "entity_updated", "updated").otherwise(F.concat(F.coalesce("edge_type", F.lit("?")), F.lit(" "), F.coalesce("other_label", "other_id")))
    return both.select("event", "at", "object_id", "other_id", said.alias("description"))


def timeline(graph: Graph, id_: str, limit: int = 20, offset: int = 0, **conditions: object) -> Page:
    """A page of events, latest first; ties by event and object."""
    return page(events(graph, id_, **conditions), limit, offset, (F.desc("at"), "event", "object_id"))
