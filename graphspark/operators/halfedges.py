"""Directed half-edges: what a walk can follow from a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def half_edges(edges: DataFrame, direction: str = "both", honour_bidirectional: bool = True) -> DataFrame:
    """a, b, edge_id, type, properties and dir ("out" if a is the stored source) for each way to go along an edge.

    A self-loop gives one row. With honour_bidirectional a bidirectional edge can be gone both ways whatever the
    direction; without, the stored direction alone counts."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    props = [F.col("properties")] if "properties" in edges.columns else []
    rest = (F.col("id").alias("edge_id"), F.col("type"), *props)
    forward = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), *rest, F.lit("out").alias("dir"), "bidirectional")
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), *rest, F.lit("in").alias("dir"), "bidirectional")
    loop = F.col("a") == F.col("b")
    both = F.col("bidirectional") if honour_bidirectional else F.lit(False)
    if direction == "out":
        out = forward.unionByName(back.where(both & ~loop))
    elif direction == "in":
        out = back.unionByName(forward.where(both & ~loop))
    else:
        out = forward.unionByName(back.where(~loop))
    return out.drop("bidirectional")
