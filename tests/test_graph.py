"""Small graphs with known outcomes."""

from __future__ import annotations

import random

import pytest

from graphspark.functions.props import Filter, bag, from_json, literal, to_json
from graphspark.model import BAG, EntityType, Graph, Property, RelationshipType, Vocabulary
from graphspark.operators import aggregate, explore, mutate, read, scc, traverse, vocabulary
from graphspark.plans.traversal import Projection, Repeat, Step, Traversal, fan_out, problems
from pyspark.sql import functions as F


def graph(spark, vertices, edges):
    v = spark.createDataFrame([(i, t, label, p) for i, t, label, p in vertices], "id string, type string, label string, p string")
    v = v.select("id", "type", "label", F.lit(None).cast("string").alias("summary"), F.coalesce(from_json(F.col("p")), F.create_map().cast(BAG)).alias("properties"))
    e = spark.createDataFrame([(i, t, a, b, p, two) for i, t, a, b, p, two in edges], "id string, type string, source_id string, target_id string, p string, bidirectional boolean")
    e = e.select("id", "type", "source_id", "target_id", F.coalesce(from_json(F.col("p")), F.create_map().cast(BAG)).alias("properties"), "bidirectional")
    return Graph(v, e)


@pytest.fixture(scope="module")
def equipment(spark):
    return graph(
        spark,
        [("equip-1", "Equipment", "Digger", "{}"), ("comp-1", "Component", "Engine", "{}"), ("comp-2", "Component", "Hydraulics", "{}"), ("fluid-1", "Fluid", "Engine Oil", '{"viscosity": 15}'), ("fluid-2", "Fluid", "Hydraulic Oil", '{"viscosity": 46}')],
        [("e1", "HAS_COMPONENT", "equip-1", "comp-1", "{}", False), ("e2", "HAS_COMPONENT", "equip-1", "comp-2", "{}", False), ("e3", "REQUIRES_FLUID", "comp-1", "fluid-1", '{"capacity": 40}', False), ("e4", "REQUIRES_FLUID", "comp-2", "fluid-2", '{"capacity": 200}', False)],
    )


@pytest.fixture(scope="module")
def social(spark):
    return graph(
        spark,
        [("alice", "person", "Alice", "{}"), ("bob", "person", "Bob", "{}"), ("acme", "company", "Acme", "{}"), ("x", "project", "Project X", "{}"), ("widget", "company", "WidgetCo", "{}")],
        [("k", "knows", "alice", "bob", "{}", True), ("w1", "works_at", "bob", "acme", "{}", False), ("l", "leads", "bob", "x", "{}", False), ("w2", "works_at", "alice", "widget", "{}", False)],
    )


ids = lambda f, c="id": sorted(r[c] for r in f.collect())


def test_hops(equipment):
    one = Traversal(start_id="equip-1", steps=(Step("out", ("HAS_COMPONENT",)),))
    assert ids(traverse.terminal(equipment, one)) == ["comp-1", "comp-2"]
    two = Traversal(start_type="Equipment", steps=(Step(), Step("out", ("REQUIRES_FLUID",))))
    assert ids(traverse.terminal(equipment, two)) == ["fluid-1", "fluid-2"]
    heavy = Traversal(start_id="equip-1", steps=(Step(), Step(relationship_filters=(Filter("capacity", "gte", 100),))))
    assert ids(traverse.terminal(equipment, heavy), "label") == ["Hydraulic Oil"]
    back = Traversal(start_id="fluid-1", steps=(Step("in"), Step("in")))
    assert ids(traverse.terminal(equipment, back)) == ["equip-1"]
    count = Traversal(start_type="Fluid", projection=Projection(("viscosity", "none"), "count"))
    assert sorted((r.viscosity, r.none, r["count"]) for r in traverse.run(equipment, count).collect()) == [("15", None, 1), ("46", None, 1)]


def test_paths_keep_every_walk(spark):
    people = [(f"p{i}", "Person", f"P{i}", "{}") for i in range(1, 7)]
    g = graph(spark, [*people, ("nexus", "Org", "Nexus", "{}"), ("orion", "Org", "Orion", "{}")], [(f"r{i}", "WORKS_AT", f"p{i}", "nexus" if i < 5 else "orion", "{}", False) for i in range(1, 7)])
    spec = Traversal(start_type="Person", steps=(Step("out", ("WORKS_AT",)),), return_mode="path")
    assert traverse.path_rows(g, spec).count() == 6
    assert ids(traverse.terminal(g, Traversal(start_type="Person", steps=spec.steps))) == ["nexus", "orion"]
    assert traverse.terminal(g, Traversal(start_type="Person", steps=spec.steps, deduplicate=False)).count() == 6
    both = Traversal(start_type="Person", steps=spec.steps, return_mode="all", limit=4)
    found = traverse.everything(g, both)
    assert sorted((r["kind"], r["count"]) for r in found.groupBy("kind").count().collect()) == [("edge", 6), ("vertex", 8)]
    v, e = traverse.page_of_everything(g, both)
    assert v.count() == 4 and e.count() == 0
    v, e = traverse.page_of_everything(g, Traversal(start_type="Person", steps=spec.steps, return_mode="all", limit=10, offset=10))
    assert e.count() == 4 and {r.id for r in v.collect()} >= {r.source_id for r in e.collect()} | {r.target_id for r in e.collect()}


def test_repeat(spark):
    g = graph(spark, [(c, "N", c, "{}") for c in "abcd"] + [("z", "Stop", "z", "{}")], [("1", "L", "a", "b", "{}", False), ("2", "L", "b", "c", "{}", False), ("3", "L", "c", "a", "{}", False), ("4", "L", "c", "z", "{}", False)])
    end = lambda r: ids(traverse.terminal(g, Traversal(start_id="a", steps=(Step("out", ("L",), repeat=r),))))
    assert end(Repeat(1)) == ["b"] and end(Repeat(2)) == ["c"]
    assert end(Repeat(3)) == ["z"] and end(Repeat(4)) == ["z"]
    assert end(Repeat(4, until_types=("Stop",))) == ["z"]
    assert ids(traverse.terminal(g, Traversal(start_id="z", steps=(Step("out", ("L",), repeat=Repeat(2)),)))) == ["z"]
    every = Traversal(start_id="a", steps=(Step("out", ("L",), repeat=Repeat(3)),), emit_all=True)
    assert ids(traverse.terminal(g, every)) == ["b", "c", "z"]


def test_neighbourhood(social):
    seen = lambda **k: sorted((r.depth, r.id) for r in explore.layers(social, **k).collect())
    assert seen(start="alice", depth=1) == [(1, "bob"), (1, "widget")]
    assert seen(start="alice", depth=2) == [(1, "bob"), (1, "widget"), (2, "acme"), (2, "x")]
    assert seen(start="bob", depth=1, direction="out") == [(1, "acme"), (1, "alice"), (1, "x")]
    assert seen(start="acme", depth=1, direction="out") == []
    assert seen(start="alice", depth=2, entity_types=["company"]) == [(1, "widget")]
    top = explore.explore(social, "bob", 1, limit_per_type=1).collect()
    assert {r.relationship_type: r.total for r in top} == {"knows": 1, "works_at": 1, "leads": 1}
    with pytest.raises(ValueError):
        explore.layers(social, "bob", 4)


def test_chain_paths(spark):
    rows = [("r1", "links", "a", "b", "{}", False), ("r2", "links", "b", "c", "{}", False)]
    v = [(c, "n", c, "{}") for c in "abcde"]
    found = lambda edges, a, b, n=5, **k: sorted(">".join(r.vertex_path) for r in explore.paths(graph(spark, v, edges), a, b, n, **k).collect())
    assert found(rows, "a", "c") == ["a>b>c"] and found(rows, "a", "c", 1) == []
    assert found(rows, "c", "a") == ["c>b>a"] and found(rows, "a", "e") == [] and found(rows, "a", "a") == ["a"]
    more = [*rows, ("r3", "links", "c", "d", "{}", False), ("r4", "links", "c", "d", "{}", False)]
    assert found(more, "a", "d") == ["a>b>c>d"] * 2
    inbound = [*rows, ("r5", "links", "d", "b", "{}", False)]
    assert found(inbound, "a", "d") == ["a>b>d"]
    diamond = [("1", "l", "a", "b", "{}", False), ("2", "l", "a", "c", "{}", False), ("3", "l", "b", "c", "{}", False), ("4", "l", "c", "d", "{}", False)]
    assert found(diamond, "a", "d") == ["a>c>d"]  # over b, c would come later than at its own distance
    assert found(diamond, "a", "d", mode="all_simple") == ["a>b>c>d", "a>c>d"]


def test_all_simple_paths_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(f"e{i}", "l", f"v{r.randrange(7)}", f"v{r.randrange(7)}", "{}", False) for i in range(12)]
    g = graph(spark, [(f"v{i}", "n", f"v{i}", "{}") for i in range(7)], edges)

    def walk(path, used):
        if path[-1] == "v1":
            yield tuple(used)
        elif len(used) < 4:
            for i, _, a, b, _, _ in edges:
                for x, y in {(a, b), (b, a)}:
                    if x == path[-1] and y not in path:
                        yield from walk([*path, y], [*used, i])

    got = sorted(tuple(x.edge_path) for x in explore.paths(g, "v0", "v1", 4, "all_simple").collect())
    assert got == sorted(walk(["v0"], []))


def test_filters(spark):
    f = spark.createDataFrame([(1, '{"a": 1, "t": "Xy", "n": null, "b": true}'), (2, '{"a": "1"}'), (3, "{}"), (4, '{"o": {"k": [1]}}')], "i int, p string").select("i", from_json(F.col("p")).alias("properties"))
    held = lambda *a: [r.i for r in f.where(Filter(*a).on(F.col("properties"))).orderBy("i").collect()]
    assert held("a", "eq", 1) == [1] and held("a", "eq", "1") == [2] and held("n", "eq", None) == [1]
    assert held("a", "neq", 1) == [2, 3, 4] and held("n", "neq", None) == [2, 3, 4] and held("b", "eq", True) == [1]
    assert held("n", "isNull") == [1, 2, 3, 4] and held("a", "isNotNull") == [1, 2]
    assert held("a", "gt", 0) == [1] and held("a", "lte", "2") == [2] and held("a", "gt", True) == []
    assert held("t", "contains", "xY") == [1] and held("a", "contains", "1") == [2]
    with pytest.raises(ValueError):
        Filter("a", "like")
    assert [r.j for r in f.select("i", to_json(F.col("properties")).alias("j")).orderBy("i").collect()][0] == '{"a":1,"b":true,"n":null,"t":"Xy"}'


def test_specifications():
    assert problems(Traversal()) and problems(Traversal(start_id="a", limit=0)) and problems(Traversal(start_id="a", steps=(Step("up"),)))
    bad = Traversal(start_id="a", steps=(Step(relationship_types=("a b",)),), projection=Projection(("id",), "sum"), return_mode="path")
    assert len(problems(bad)) == 4
    assert not problems(Traversal(start_type="T", steps=(Step(repeat=Repeat(3)),)))
    assert fan_out(Traversal(start_id="a", steps=(Step(), Step(repeat=Repeat(3))))) == 300


def test_reads(equipment, spark):
    page = read.find(equipment, 2, 0, types=["Component", "Fluid"])
    assert ids(page.rows) == ["comp-1", "comp-2"] and page.total == 4 and page.has_more
    assert ids(read.find(equipment, term="OIL").rows) == ["fluid-1", "fluid-2"]
    assert ids(read.find(equipment, properties={"viscosity": 46}).rows) == ["fluid-2"] and read.find(equipment, properties={"viscosity": "46"}).total == 0
    assert [len(c) for c in (read.chunks(equipment.vertices.select("id"), 2).collect(),)] == [5]
    assert sorted((r.sequence, r.is_last) for r in read.chunks(equipment.vertices.select("id"), 2).collect()) == [(0, False)] * 2 + [(1, False)] * 2 + [(2, True)]
    summed = {r.id: (r.outgoing, r.incoming) for r in traverse.with_relationship_summary(equipment, equipment.vertices).collect()}
    assert summed["comp-1"] == ({"REQUIRES_FLUID": 1}, {"HAS_COMPONENT": 1}) and summed["fluid-1"] == ({}, {"REQUIRES_FLUID": 1})
    loop = graph(spark, [("a", "n", "a", "{}")], [("s", "l", "a", "a", "{}", False)])
    assert all(read.relationships(loop, "a", d).count() == 1 for d in ("in", "out", "both"))
    assert [(r.direction, r.n) for r in aggregate.relationship_summary(loop).orderBy("direction").collect()] == [("in", 1), ("out", 1)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(12):02d}", f"n{r.randrange(12):02d}") for _ in range(18)]
    got = {x.id: x.component for x in scc.strongly_connected(spark.createDataFrame(pairs, "source_id string, target_id string")).collect()}
    names = sorted({x for p in pairs for x in p})
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            for n in names:
                if a in reach[n]:
                    reach[n].add(b)
    assert got == {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}


VOCABULARY = Vocabulary((EntityType("person", properties=(Property("role", "string", True), Property("age", "number"))), EntityType("project"), EntityType("event", properties=(Property("eventType", "string", True),))), (RelationshipType("WORKS_ON", sources=("person",), targets=("project",)), RelationshipType("KNOWS", bidirectional=True)), "1.0.0")


def test_audit(spark):
    g = graph(spark, [("a", "person", "A", '{"role": "dev", "age": "old", "x": 1}'), ("b", "person", " ", "{}"), ("c", "alien", "C", "{}"), ("p", "project", "P", '{"any": 1}')], [("1", "worksOn", "a", "p", "{}", False), ("2", "works-on", "p", "a", "{}", False), ("3", "WORKS_ON", "a", "ghost", "{}", False), ("4", "KNOWS", "a", "a", "{}", False), ("5", "HATES", "a", "b", "{}", False)])
    assert sorted((r.id, r.code, r.field) for r in vocabulary.audit_entities(g, VOCABULARY).collect()) == [("a", "type", "age"), ("a", "unknown_property", "x"), ("b", "label", "label"), ("c", "unknown_type", "alien")]
    assert sorted((r.id, r.code) for r in vocabulary.audit_relationships(g, VOCABULARY).collect()) == [("2", "source_type"), ("2", "target_type"), ("3", "missing_target"), ("4", "self_reference"), ("5", "unknown_type")]
    rows, done = vocabulary.audit_page(vocabulary.audit_entities(g, VOCABULARY), 0, 3)
    assert rows.count() == 3 and not done


def test_governance():
    add = lambda t: vocabulary.Proposal("add", entity=EntityType(t))
    decide = vocabulary.decide
    assert decide(VOCABULARY, add("place"), vocabulary.Governance("locked")).status == "rejected"
    assert decide(VOCABULARY, add("Person"), vocabulary.Governance()).reason == "like person"
    assert decide(VOCABULARY, add("place"), vocabulary.Governance("managed", True)).status == "pending"
    done = decide(VOCABULARY, add("place"), vocabulary.Governance())
    assert done.status == "applied" and done.vocabulary.version == "1.1.0" and done.vocabulary.entity("place")
    gone = vocabulary.apply(VOCABULARY, vocabulary.Proposal("delete", name="event"))
    assert gone.version == "2.0.0" and not gone.entity("event")
    with pytest.raises(ValueError):
        vocabulary.migrate(done.vocabulary, VOCABULARY, "reject")
    assert vocabulary.migrate(done.vocabulary, VOCABULARY).entity("place")
    props = vocabulary.merged_properties((Property("a"), Property("b")), ["a"], [Property("b", "number")], [Property("b"), Property("c")])
    assert [(p.name, p.type) for p in props] == [("b", "number"), ("c", "string")]


def test_mutations(spark, social):
    left = mutate.delete_vertices(social, spark.createDataFrame([("bob",), ("nobody",)], "id string"))
    assert ids(left.edges) == ["w2"] and left.vertices.count() == 4
    new = graph(spark, [("d", "person", "Dan", '{"role": "dev"}'), ("e", "person", "Eve", "{}"), ("alice", "person", "A", '{"role": "x"}')], [("n1", "knows", "d", "alice", "{}", False), ("n2", "knows", "d", "d", "{}", False), ("n3", "worksOn", "d", "x", "{}", False), ("n4", "worksOn", "acme", "x", "{}", False)])
    grown, refused = mutate.create_vertices(social, new.vertices, VOCABULARY)
    assert grown.vertices.count() == 6 and ids(refused) == ["alice", "e"]
    tied, bad = mutate.create_relationships(grown, new.edges, VOCABULARY)
    assert ids(bad) == ["n2", "n4"] and {r.id: r.bidirectional for r in tied.edges.where("id like 'n%'").collect()} == {"n1": True, "n3": False}
    patch = spark.range(1).select(F.lit("d").alias("id"), F.lit(None).cast("string").alias("label"), bag(role=literal(None), age=literal(3)).cast(BAG).alias("properties"))
    row = mutate.update_vertices(grown, patch).vertices.where("id = 'd'").first()
    assert row.label == "Dan" and list(row.properties) == ["age"]
    slugs = mutate.with_slugs(spark.createDataFrame([("1", "t", "A b"), ("2", "t", "a-B"), ("3", "t", "!!")], "id string, type string, label string"), spark.createDataFrame([("t:a-b",)], "slug string"))
    assert {r.id: r.slug for r in slugs.collect()} == {"1": "t:a-b-2", "2": "t:a-b-3", "3": "t:unnamed"}


def test_merges(spark, social):
    new = graph(spark, [("bob", "person", "Robert", "{}"), ("zoe", "person", "Zoe", "{}")], [("m1", "knows", "zoe", "bob", "{}", False), ("m2", "works_at", "bob", "acme", "{}", False), ("m3", "knows", "zoe", "ghost", "{}", False)])
    for policy, label in (("skip", "Bob"), ("overwrite", "Robert"), ("rename", "Bob")):
        vertices, log = mutate.merge_vertices(social, new.vertices, policy)
        assert vertices.where("id = 'bob'").first().label == label and vertices.count() == (7 if policy == "rename" else 6)
        edges, warned = mutate.merge_edges(vertices, social.edges, new.edges, log)
        wanted = {"m3": "orphan"} if policy == "rename" else {"m2": "duplicate", "m3": "orphan"}
        assert {r.id: r.warning for r in warned.collect()} == wanted
    g, errors = mutate.bulk_import(social, new.vertices, new.edges.union(social.edges.where("id = 'k'").withColumn("type", F.lit("likes"))))
    assert {r.id: r.code for r in errors.collect()} == {"m3": "missing_end", "k": "id_reused"} and g.edges.count() == 6
    same, errors = mutate.bulk_import(social, new.vertices, new.edges, all_or_nothing=True)
    assert same is social and errors.count() == 1
