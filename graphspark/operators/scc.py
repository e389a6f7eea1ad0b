"""Strongly connected components by trimming, forward and backward search, and one task for a small rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.plans.scratch import stored

#: Edges that one task may take; a larger graph is first cut by distributed rounds.
SMALL = 500_000


def strongly_connected(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id and component (the smallest id of the component) of every vertex in edges (source_id, target_id); no rows for
    no edges.

    Vertices without incoming or outgoing open edges are components of their own and leave. While more than `small`
    edges are open, every vertex takes the first colour (in an order by hash) that reaches it, and a component is what
    reaches its colour's vertex backwards within the colour; edges between colours join no component and leave, too.
    The rest is solved in one task."""
    kind = edges.schema["source_id"].dataType.simpleString()
    left = stored(edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), "scc")
    open_edges = stored(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a <> b").distinct(), "scc")
    groups = left.limit(0).select("id", F.col("id").alias("root"))
    while open_edges.count() > small:
        inner = open_edges.select(F.col("a").alias("id")).intersect(open_edges.select(F.col("b").alias("id")))
        colour = _spread(stored(inner.withColumn("colour", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("v"))), "scc"), open_edges)
        within = stored(_within(open_edges, colour), "scc")
        found = reached = colour.where("id = colour.v").select("id", F.col("id").alias("root"))
        while True:
            back = within.join(reached, (F.col("b") == F.col("id")) & (F.col("c") == F.col("root"))).select(F.col("a").alias("id"), "root").distinct()
            reached = stored(back.join(found, ["id", "root"], "left_anti"), "scc")
            if reached.isEmpty():
                break
            found = stored(found.unionByName(reached), "scc")
        groups = groups.unionByName(found)
        done = found.select(F.col("id").alias("v"))
        open_edges = stored(within.select("a", "b").join(done, F.col("a") == F.col("v"), "left_anti").join(done, F.col("b") == F.col("v"), "left_anti"), "scc")
    # at most `small` edges: a bounded group
    rest = open_edges.coalesce(1).mapInPandas(_tarjan, f"id {kind}, root {kind}")
    groups = stored(groups.unionByName(rest), "scc")
    named = groups.join(groups.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
    return left.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _tarjan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of all edges (a, b) of a task: id and a vertex that names the component."""
    out: dict = {}
    for pdf in parts:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    root: dict = {}
    stack: list = []
    for first in out:
        if first in number:
            continue
        work = [(first, iter(out[first]))]
        number[first] = low[first] = len(number)
        stack.append(first)
        while work:
            v, ways = work[-1]
            for w in ways:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    work.append((w, iter(out[w])))
                    break
                if w not in root:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    while v not in root:
                        root[stack.pop()] = v
    yield pd.DataFrame({"id": list(root), "root": list(root.values())}) if root else pd.DataFrame({"id": [], "root": []})


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    while True:
        heard = edges.join(colour, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("m"))
        new = stored(colour.join(heard, "id", "left").select("id", F.least("colour", F.coalesce("m", "colour")).alias("colour")), "scc")
        if new.join(colour, ["id", "colour"], "left_anti").isEmpty():
            return new
        colour = new


def _within(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The edges whose ends have one colour, with its vertex as c."""
    one = edges.join(colour.select(F.col("id").alias("a"), F.col("colour.v").alias("c")), "a")
    return one.join(colour.select(F.col("id").alias("b"), F.col("colour.v").alias("d")), "b").where("c = d").drop("d")


def cycles(components: DataFrame) -> DataFrame:
    """component and size of those with more than one vertex."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
