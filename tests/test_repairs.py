"""Cases that once went wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphspark.model import EDGE, VERTEX, Graph
from graphspark.operators import mutate, planning, scc
from graphspark.repository import Conflict, Store


def vertices(spark, *rows):
    return spark.createDataFrame([(i, s, "T", i) for i, s in rows], "id string, slug string, type string, label string")


def test_renamed_rows_get_free_ids_and_slugs(spark):
    old = vertices(spark, ("a", "T:a"), ("a-imported", "T:a-imported"), ("b", "T:b"), ("b-imported-7", "T:z"))
    new, log = mutate.merge_vertices(Graph(old, spark.createDataFrame([], EDGE)), vertices(spark, ("a", "T:a"), ("b", "T:b"), ("c", "T:c"), ("a-imported", "T:y")), "rename")
    got = {r.id_in: r.id_out for r in log.collect()}
    assert got == {"a": "a-imported-2", "b": "b-imported", "c": "c", "a-imported": "a-imported-imported"}
    rows = new.collect()
    assert len({r.id for r in rows}) == len(rows) == 8 and len({r.slug for r in rows}) == 8
    assert {r.id: r.slug for r in rows}["a-imported-2"] == "T:a-imported-2"


def test_new_slugs_are_free(spark):
    new = spark.createDataFrame([("1", "T", "a"), ("2", "T", "a"), ("3", "T", "a-9"), ("4", "T", "b"), ("5", "T", "b")], "id string, type string, label string")
    got = {r.id: r.slug for r in mutate.with_slugs(new, vertices(spark, ("x", "T:a"), ("y", "T:a-3"))).collect()}
    assert got == {"1": "T:a-10", "2": "T:a-11", "3": "T:a-9", "4": "T:b", "5": "T:b-2"}


def brute_components(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    far = {v: reach(v) for v in near}
    return {v: min(w for w in far[v] if v in far[w]) for v in near}


@pytest.mark.parametrize("small", [500_000, 5])
def test_components(spark, small):
    import random

    r = random.Random(3)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(45)] + [(40, 41), (41, 42), (42, 40), (50, 50)]
    edges = spark.createDataFrame(pairs, "source_id long, target_id long")
    assert {x.id: x.component for x in scc.strongly_connected(edges, small).collect()} == brute_components(pairs)
    assert scc.strongly_connected(edges.where("false"), small).count() == 0


def test_all_workers_take_part(spark):
    workers = spark.range(1500).select(F.concat(F.lit("w"), "id").alias("name"), F.array(F.lit("structured-extraction")).alias("capabilities"), F.lit(50_000).alias("context_window"), F.lit(1000).alias("max_output"), (2000 - F.col("id")).cast("double").alias("input_cost"), F.lit(0.0).alias("output_cost"), F.col("id").cast("int").alias("ord"))
    docs = spark.createDataFrame([("s", "spec-sheet", 100)], "source string, type string, tokens long")
    assert planning.assign_workers(docs, workers).first().worker == "w1499"


def test_store_survives_crashes_and_races(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    repo = store.create("One")
    rid = repo.info.repository_id
    first, second = store.open(rid), store.open(rid)
    first.update(label="Two")
    with pytest.raises(Conflict):
        second.update(label="Three")
    numbers = store._revisions(rid)
    (tmp_path / "store" / rid / f"info-{numbers[-1] + 1:09d}.json").write_text('{"label": "cut o')  # a crash while writing
    (tmp_path / "store" / rid / "v-left").mkdir()
    again = store.open(rid)
    assert again.info.label == "Two"
    again.save(Graph(spark.createDataFrame([("a", "entities")], "id string, label string").withColumn("type", F.lit("T")), spark.createDataFrame([], EDGE)))
    assert store.open(rid).sql("SELECT label FROM entities WHERE label = 'entities'").first().label == "entities"
    with pytest.raises(Conflict):
        store._write(f"{rid}/info-{numbers[-1]:09d}.json", "{}")


def test_archives_replace_vocabularies_forward(spark, tmp_path):
    from graphspark.model import EntityType, Vocabulary

    repo = Store(spark, f"file://{tmp_path}/store").create("One", Vocabulary((EntityType("T"),), (), "3.1.0"))
    rows = spark.createDataFrame([("a", "x")], "id string, label string").withColumn("type", F.lit("T"))
    repo.import_archive(Graph(rows, spark.createDataFrame([], EDGE)), Vocabulary((EntityType("U"),), (), "1.0.0"))
    assert repo.vocabulary.version == "1.0.0"
    repo.import_archive(Graph(rows.withColumn("label", F.lit("y")), spark.createDataFrame([], EDGE)), Vocabulary((EntityType("W"),), (), "1.5.0"))
    assert repo.vocabulary.version == "2.0.0" and [(r.id, r.label) for r in repo.graph.vertices.collect()] == [("a", "y")]
    page = repo.page(10)
    assert page.vocabulary.version == "2.0.0" and page.statistics.count() >= 1 and VERTEX
