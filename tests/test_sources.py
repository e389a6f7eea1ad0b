"""Archives, folders, vocabularies in Markdown, stores and streams."""

from __future__ import annotations

import json

import pytest

from graphspark.model import EntityType, Property, RelationshipType, Vocabulary
from graphspark.operators.vocabulary import Governance, Proposal
from graphspark.operators import search
from graphspark.repository import Cancelled, Conflict, Store
from graphspark.sources import archive, code_repository, documents, vocabulary_markdown
from graphspark.sources.star_graph import star_graph
from graphspark.streaming.incremental import current, event_counts, import_stream

from paths import SMALL

VOCABULARY = Vocabulary((EntityType("Nation", properties=(Property("k", "enum", values=("a",)),)),), (RelationshipType("TRADES_WITH", sources=("Nation",), bidirectional=True),), "1.2.0")


@pytest.fixture(scope="module")
def nations(spark):
    return star_graph(spark, SMALL, ("Nation", "Region"), ("IN_REGION",))


def rows(f):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in f.collect())


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_archive_round_trip(spark, nations, tmp_path, form):
    schemas = (nations.vertices.schema, nations.edges.schema)
    archive.export(nations, VOCABULARY, str(tmp_path / form), form)
    g, v = archive.load(spark, str(tmp_path / form), schemas, form)
    assert v == VOCABULARY and rows(g.vertices) == rows(nations.vertices) and rows(g.edges) == rows(nations.edges)


def test_zip_and_stream(spark, nations):
    def ddl(f):
        return ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in f.schema.fields)

    g, v = archive.unzipped(spark, archive.zipped(nations, VOCABULARY), (ddl(nations.vertices), ddl(nations.edges)))
    assert v == VOCABULARY and rows(g.vertices) == rows(nations.vertices) and rows(g.edges) == rows(nations.edges)
    assert [(p, len(r)) for p, r in archive.stream(nations, 20)] == [("entities", 20), ("entities", 10), ("relationships", 20), ("relationships", 5)]


def test_folders(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.html").write_text("<p>x</p>")
    found = documents.source_list(spark, str(tmp_path))
    assert sorted((r.ending, r.status) for r in found.collect()) == [("html", "needs-conversion"), ("md", "pending")]
    assert documents.changed_sources(found, found).count() == 0
    assert documents.matching_sources(found, ["sub/"]).count() == 1
    page = spark.createDataFrame([("<html><head><title>t</title></head><!-- c --><p>a &amp;\n b</p><script>x</script></html>",)], "h string")
    assert page.select(documents.plain_text("h").alias("t")).first().t == "a & b"


def test_extraction_rows(spark):
    answer = '{"entities": [{"entityType": "P", "label": "A", "properties": {"x": "1"}}, {"entityType": "P", "label": "B"}], "relationships": [{"type": "R", "sourceLabel": "A", "targetLabel": "B"}, {"ty'
    e, r = documents.extraction_rows(spark.createDataFrame([("s", answer), ("t", "no")], "source string, answer string"))
    assert [(x.ord, x.label) for x in e.orderBy("ord").collect()] == [(0, "A"), (1, "B")] and r.first().target_label == "B"


def test_markdown_vocabulary():
    doc = """# V
## Entity Types
### Person
A human.

| Property | Type | Required | Description |
|---|---|---|---|
| `name` | string | yes | Full name |
| `mood` | enum | no | one of `good`, `bad` |

### Place
Somewhere.

| Recommended value | Meaning |
|---|---|
| `city` | x |

## Relationship Types
### Social
| Type | Description | Source → Target | Bidirectional |
|---|---|---|---|
| `KNOWS` | knows | Person → Person | yes |
| `LIVES_IN` | lives | Person, Robot → Place | no |

#### Properties for `LIVES_IN`
| Property | Type | Required | Description |
|---|---|---|---|
| `since` | date | no | when |
"""
    v = vocabulary_markdown.parse(doc)
    assert [t.type for t in v.entity_types] == ["Person", "Place"] and v.entity("Person").description == "A human."
    assert v.entity("Person").properties == (Property("name", "string", True, "Full name"), Property("mood", "enum", False, "one of `good`, `bad`", ("good", "bad")))
    assert v.relationship("KNOWS").bidirectional and v.relationship("LIVES_IN").sources == ("Person", "Robot")
    assert v.relationship("LIVES_IN").properties[0].type == "date"
    assert vocabulary_markdown.controlled_values(doc) == {"Place": ["city"]}


def test_code_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("import { b } from './b.js';\nimport x from 'zod';\nexport class OddError extends Error {}\n")
    (tmp_path / "src" / "b.ts").write_text("export { a } from '../src/a.js';\n")
    (tmp_path / "src" / "a.test.ts").write_text("import { a } from './a.js';\n")
    g = code_repository.code_graph(spark, str(tmp_path))
    got = sorted((r.type, r.source_id, r.target_id) for r in g.edges.collect())
    assert got == [("IMPORTS", "module:src/a", "module:src/b"), ("IMPORTS", "module:src/a", "package:zod"), ("IMPORTS", "module:src/a.test", "module:src/a"), ("IMPORTS", "module:src/b", "module:src/a"), ("TESTS", "module:src/a.test", "module:src/a")]
    assert [r.name for r in code_repository.error_classes(code_repository.files(spark, str(tmp_path))).collect()] == ["OddError"]


def test_store(spark, nations, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    repo = store.create("Nations", VOCABULARY, type="geo")
    repo.save(nations)
    again = store.open(repo.info.repository_id)
    assert again.graph.vertices.count() == 30 and again.vocabulary == VOCABULARY and [i.label for i in store.list(type_="geo")] == ["Nations"]
    assert again.find(types=["Nation"]).total == 25 and again.explore("region:1").count() == 5 and again.statistics().count() == 5
    again.update(metadata={"a": 1})
    with pytest.raises(Conflict):
        repo.update(label="late")
    again.update(metadata={"b": 2})
    assert json.loads(store.open(again.info.repository_id).info.metadata) == {"a": 1, "b": 2}
    assert again.propose(Proposal("add", entity=EntityType("Planet"))).status == "applied" and again.vocabulary.version == "1.3.0"
    assert again.sql("SELECT type, count(*) AS n FROM entities WHERE type = :t GROUP BY type", t="Nation").first().n == 25
    page = again.page(20, 0)
    assert page.vertices.count() == 20 and page.cursor == "offset:20" and page.total_edges == 20 and not page.truncated
    again.re_embed(["k"])
    assert again.search_by_concept(search.hash_embedding(again.graph.vertices.where("id = 'nation:3'").first().label), threshold=0.999).where("id = 'nation:3'").count() == 1

    def refuse(kind, subject):
        raise Cancelled(kind)

    again.hooks.append(refuse)
    with pytest.raises(Cancelled):
        again.update(label="x")
    again.hooks.clear()
    again.update(governance=Governance("locked"))
    assert again.propose(Proposal("add", entity=EntityType("Moon"))).status == "rejected"
    assert {r.code for r in again.validate().collect()} == {"unknown_type", "unknown_property"}
    assert again.clear() == (30, 25) and again.graph.vertices.count() == 0
    store.delete(again.info.repository_id)
    assert store.list() == []
    with pytest.raises(KeyError):
        store.open(again.info.repository_id)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda n, rs: (tmp_path / "in" / n).write_text("\n".join(json.dumps(r) for r in rs))
    write("1.json", [{"id": "a", "ord": 1, "label": "old"}, {"id": "b", "ord": 1, "label": "b"}, {"id": "a", "ord": 2, "label": "new"}])
    run = lambda: import_stream(spark, str(tmp_path / "in"), "id string, ord long, label string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    write("2.json", [{"id": "b", "ord": 3, "label": "B"}, {"id": "c", "ord": 1, "label": "c"}])
    run()
    assert {r.id: r.label for r in current(spark, str(tmp_path / "out")).collect()} == {"a": "new", "b": "B", "c": "c"}


def test_streamed_counts_are_the_batch_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in event_counts(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.sql("SELECT * FROM live").collect()} == want and want
