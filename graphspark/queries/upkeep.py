"""Queries of archives, imports, governance, reviews and planning, with their SQL.

Small objects that the driver handles (vocabularies, specifications, decisions) come out as rows, whose SQL states the
expected values."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions.props import Filter, bag, literal, number, text
from graphspark.model import BAG, EDGE, VERTEX, EntityType, Graph, Property, RelationshipType, Vocabulary
from graphspark.operators import aggregate, corrections, explore, extraction, mutate, planning, read, search, timeline, traverse, vocabulary
from graphspark.operators import text as lines
from graphspark.operators.vocabulary import Governance, Proposal
from graphspark.plans.scratch import scratch_root
from graphspark.plans.traversal import Projection, Repeat, Step, Traversal, fan_out, problems
from graphspark.repository import Store
from graphspark.sources import archive, code_repository, documents, vocabulary_markdown
from graphspark.sources.star_graph import SQL_EDGES, SQL_VERTICES, star_graph
from graphspark.streaming.incremental import current, import_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_VE = f"WITH {SQL_VERTICES}, {SQL_EDGES}"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/graphspark/{name}-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, d: str) -> Graph:
    return star_graph(spark, d, ("Nation", "Region"), ("IN_REGION",))


def _rows(spark: SparkSession, schema: str, *rows: tuple[Any, ...]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


_NATION_ROWS = "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS type, n_name AS label FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 'IN_REGION:' || n_nationkey, 'IN_REGION', 'nation:' || n_nationkey || '>region:' || n_regionkey FROM nation"


def _all_rows(g: Graph) -> DataFrame:
    return g.vertices.select("id", "type", "label").unionByName(g.edges.select("id", "type", F.concat_ws(">", "source_id", "target_id").alias("label")))


# --- archives, imports, stores ----------------------------------------------------------------------------------------


@query(_NATION_ROWS)
def archive_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "archive")
    archive.export(_nations(spark, d), Vocabulary((EntityType("Nation"),)), at)
    return _all_rows(archive.load(spark, at, (VERTEX, EDGE))[0])


@query(_NATION_ROWS)
def zip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _all_rows(archive.unzipped(spark, archive.zipped(_nations(spark, d), Vocabulary()), (VERTEX, EDGE))[0])


@query("SELECT part, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'entities' AS part, unnest([10, 10, 10]) AS n UNION ALL SELECT 'relationships', unnest([10, 10, 5])) GROUP BY part")
def archive_stream(spark: SparkSession, d: str) -> DataFrame:
    sent = [(part, len(rows)) for part, rows in archive.stream(_nations(spark, d), 10)]
    return _rows(spark, "part string, n long", *sent).groupBy("part").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n"))


def _half(spark: SparkSession, d: str) -> tuple[Graph, DataFrame, DataFrame]:
    """Customers with even keys; all are imported, with their nations' edges and one edge to nothing each."""
    g = star_graph(spark, d, ("Customer", "Nation"), ("IN_NATION",))
    key = F.expr("cast(substring_index(id, ':', -1) as long)")
    stored = g.vertices.where((F.col("type") == "Nation") | (key % 2 == 0))
    lost = g.edges.where("id like 'IN_NATION:c:%'").select(F.concat("id", F.lit("x")).alias("id"), "type", "source_id", F.concat("target_id", F.lit("x")).alias("target_id"), "properties", "bidirectional")
    new = g.vertices.where("type = 'Customer'").withColumn("label", F.upper("label"))
    return Graph(stored, g.edges.limit(0)), new, g.edges.where("id like 'IN_NATION:c:%'").unionByName(lost)


@query("SELECT 'customer:' || c_custkey AS id, upper(c_name) AS label FROM customer UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'IN_NATION:c:customer:' || c_custkey, 'edge' FROM customer WHERE false UNION ALL SELECT 'IN_NATION:c:' || c_custkey, 'edge' FROM customer UNION ALL SELECT 'IN_NATION:c:' || c_custkey || 'x', 'missing_end' FROM customer")
def bulk_import_upserts(spark: SparkSession, d: str) -> DataFrame:
    out, errors = mutate.bulk_import(*_half(spark, d))
    return out.vertices.select("id", "label").unionByName(out.edges.select("id", F.lit("edge").alias("label"))).unionByName(errors.select("id", F.col("code").alias("label")))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS label FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation")
def bulk_import_all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    out, _ = mutate.bulk_import(*_half(spark, d), all_or_nothing=True)
    return out.vertices.select("id", "label")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' (new)' ELSE p_name END AS label FROM part")
def stream_import(spark: SparkSession, d: str) -> DataFrame:
    """All parts in one file, every third again in a second run."""
    source, target = _place(spark, "incoming"), _place(spark, "table")
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("ord"), F.col("p_name").alias("label"))
    for rows in (p, p.where("id % 3 = 0").withColumn("label", F.concat("label", F.lit(" (new)")))):
        rows.write.mode("append").json(source)
        import_stream(spark, source, "id long, ord int, label string", target, f"{target}-log").awaitTermination()
    return current(spark, target).select("id", "label")


@query("SELECT 'customer:' || c_custkey || CASE WHEN c_custkey % 3 = 1 THEN 'x' ELSE '' END AS id_in, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE 'created' END AS action FROM customer WHERE c_custkey % 3 <> 2")
def import_log(spark: SparkSession, d: str) -> DataFrame:
    from graphspark.queries.graph import _incoming

    g = star_graph(spark, d, ("Customer",), ("PLACED",))
    return mutate.merge_vertices(g, _incoming(g), "rename")[1].select("id_in", "action")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'skipped' ELSE 'created' END AS action, count(*) AS n FROM customer WHERE c_custkey % 3 <> 2 GROUP BY action")
def import_statistics(spark: SparkSession, d: str) -> DataFrame:
    from graphspark.queries.graph import _incoming

    g = star_graph(spark, d, ("Customer",), ("PLACED",))
    return mutate.import_statistics(mutate.merge_vertices(g, _incoming(g), "skip")[1])


@query("SELECT 'new:' || o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'orphan' ELSE 'duplicate' END AS warning FROM orders")
def import_edge_warnings(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer", "Order"), ("PLACED",))
    odd = F.expr("cast(substring(source_id, 10) as long) % 2 = 0")
    incoming = g.edges.withColumn("id", F.regexp_replace("id", "^PLACED", "new")).withColumn("source_id", F.when(odd, F.concat("source_id", F.lit("x"))).otherwise(F.col("source_id")))
    log = g.vertices.select(F.col("id").alias("id_in"), F.col("id").alias("id_out"), F.lit("skipped").alias("action"))
    return mutate.merge_edges(g.vertices, g.edges, incoming, log)[1]


def _stored(spark: SparkSession, d: str) -> Any:
    repo = Store(spark, _place(spark, "store")).create("Nations", Vocabulary((EntityType("Nation"), EntityType("Region")), (RelationshipType("IN_REGION"),), "1.0.0"), type="geo")
    repo.save(_nations(spark, d))
    return repo


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def repository_sql(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).sql("SELECT cast(substring(target_id, 8) AS int) AS region, count(*) AS n FROM relationships WHERE type = :t GROUP BY 1", t="IN_REGION")


@query("SELECT * FROM (VALUES ('created', 'Nations', 30), ('renamed', 'Places', 30), ('cleared', 'Places', 0), ('conflict', 'late', -1), ('deleted', '', -1)) v(step, label, entities)")
def repository_life(spark: SparkSession, d: str) -> DataFrame:
    from graphspark.repository import Conflict

    repo = _stored(spark, d)
    rid, late = repo.info.repository_id, repo.store.open(repo.info.repository_id)
    steps = [("created", repo.info.label, repo.graph.vertices.count())]
    repo.update(label="Places")
    steps.append(("renamed", repo.store.open(rid).info.label, repo.graph.vertices.count()))
    repo.clear()
    steps.append(("cleared", repo.store.list(type_="geo")[0].label, repo.store.open(rid).graph.vertices.count()))
    try:
        late.update(label="late")
    except Conflict:
        steps.append(("conflict", "late", -1))
    repo.store.delete(rid)
    steps += [("deleted", "", -1)] if not repo.store.list() else []
    return _rows(spark, "step string, label string, entities int", *steps)


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS label FROM nation")
def re_embed(spark: SparkSession, d: str) -> DataFrame:
    """Each nation is the nearest one to its own label's vector."""
    repo = _stored(spark, d)
    repo.re_embed([])
    v = repo.graph.vertices.where("type = 'Nation'")
    own = search.embedder()(F.col("label"))
    return v.withColumn("own", own).where(F.expr("aggregate(zip_with(own, embedding, (a, b) -> double(a) * double(b)), double(0), (s, x) -> s + x)") > 0.999).select("id", "label")


@query(f"{_VE}, p AS (SELECT id FROM V WHERE type = 'Nation' ORDER BY id LIMIT 10 OFFSET 5), n AS (SELECT * FROM E WHERE type = 'TRADES_WITH' AND (source_id IN (SELECT id FROM p) OR target_id IN (SELECT id FROM p))) SELECT n.id, coalesce(a.label, n.source_id) AS source_label, coalesce(b.label, n.target_id) AS target_label, (SELECT count(*) FROM nation) AS entities FROM n LEFT JOIN (SELECT * FROM V WHERE id IN (SELECT id FROM p)) a ON a.id = n.source_id LEFT JOIN (SELECT * FROM V WHERE id IN (SELECT id FROM p)) b ON b.id = n.target_id")
def graph_page(spark: SparkSession, d: str) -> DataFrame:
    page = read.graph_page(star_graph(spark, d, ("Nation",), ("TRADES_WITH",)), 10, 5)
    total = page.statistics.where("kind = 'entity' and type is null").first()["n"]
    return page.edges.select("id", "source_label", "target_label", F.lit(total).cast("long").alias("entities"))


# --- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS name, CAST(length(n_name) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS hash, 'pending' AS status FROM nation")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "files")
    _table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("name")).repartition("name").write.partitionBy("name").text(at)
    found = documents.source_list(spark, at, "*.txt")
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "bytes", "hash", "status")


@query("SELECT n_name || '.md' AS path FROM nation WHERE n_regionkey <> 2")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    now = n.select(F.concat("n_name", F.lit(".md")).alias("path"), F.md5("n_name").alias("hash"))
    before = n.where("n_regionkey <> 1").select(F.concat("n_name", F.lit(".md")).alias("path"), F.when(F.col("n_regionkey") == 2, F.md5("n_name")).otherwise(F.lit("old")).alias("hash"))
    return documents.changed_sources(now, before).select("path")


@query("SELECT n_name AS name FROM nation WHERE contains(n_name, '_1') OR contains(n_name, '_2')")
def filtered_sources(spark: SparkSession, d: str) -> DataFrame:
    return documents.matching_sources(_table(spark, d, "nation").select(F.col("n_name").alias("path")), ["_1", "_2"]).select(F.col("path").alias("name"))


@query("SELECT n_nationkey AS k, n_name || ' & region ' || n_regionkey || ' < 9' AS content FROM nation")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><title>x</title></head><script>var a = '<b>';</script><p>"), "n_name", F.lit(" &amp; region\n <b>"), F.col("n_regionkey").cast("string"), F.lit("</b> &lt; 9<!-- no --></p>"))
    return _table(spark, d, "nation").withColumn("page", page).select(F.col("n_nationkey").alias("k"), documents.plain_text("page").alias("content"))


@query("SELECT n_name AS source, 'entity' AS kind, 'A' || n_nationkey AS label FROM nation UNION ALL SELECT n_name, 'relationship', 'A' || n_nationkey || '>B' FROM nation")
def extraction_rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    answer = F.concat(F.lit('{"entities": [{"entityType": "T", "label": "A'), key, F.lit('"}], "relationships": [{"type": "R", "sourceLabel": "A'), key, F.lit('", "targetLabel": "B"}]}'))
    e, r = documents.extraction_rows(_table(spark, d, "nation").select(F.col("n_name").alias("source"), answer.alias("answer")))
    return e.select("source", F.lit("entity").alias("kind"), "label").unionByName(r.select("source", F.lit("relationship").alias("kind"), F.concat_ws(">", "source_label", "target_label").alias("label")))


_DOC = """# Vocabulary
## Entity Types
### Person
A human.

| Property | Type | Required | Description |
|---|---|---|---|
| `name` | string | yes | Full name |

## Relationship Types
### Social
| Type | Description | Source → Target | Bidirectional |
|---|---|---|---|
| `KNOWS` | knows | Person → Person | yes |
"""


@query("SELECT * FROM (VALUES ('entity', 'Person', 'name:string:true'), ('relationship', 'KNOWS', 'Person>Person:true')) v(kind, type, detail)")
def markdown_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    v = vocabulary_markdown.parse(_DOC)
    flag = lambda b: str(b).lower()
    e = [("entity", t.type, ",".join(f"{p.name}:{p.type}:{flag(p.required)}" for p in t.properties)) for t in v.entity_types]
    r = [("relationship", t.type, f"{','.join(t.sources)}>{','.join(t.targets)}:{flag(t.bidirectional)}") for t in v.relationship_types]
    return _rows(spark, "kind string, type string, detail string", *e, *r)


@query("SELECT * FROM (VALUES ('IMPORTS', 'module:a', 'module:b'), ('IMPORTS', 'module:a', 'package:zod'), ('IMPORTS', 'module:b', 'module:a')) v(type, source_id, target_id)")
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "code")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, source in (("a.ts", "import { b } from './b.js';\nimport z from 'zod';\n"), ("b.ts", "import { a } from './a.js';\n")):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"))
        out.write(bytearray(source.encode()))
        out.close()
    return code_repository.code_graph(spark, at).edges.select("type", "source_id", "target_id")


# --- filters, joins, traversals ------------------------------------------------------------------------------------------


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size % 5 <> 0")
def filter_is_not_null(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 5 == 0, bag(k=literal(None)).cast(BAG)).otherwise(bag(k=number(F.col("p_size"))).cast(BAG)).alias("properties"))
    return p.where(Filter("k", "isNotNull").on(F.col("properties"))).select("id")


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'absent' ELSE 'null' END AS how FROM part WHERE p_size % 5 < 2")
def filter_is_null(spark: SparkSession, d: str) -> DataFrame:
    """A missing key and an explicit null are both null."""
    k = F.col("p_size") % 5
    p = _table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.when(k == 0, F.create_map().cast(BAG)).when(k == 1, bag(k=literal(None)).cast(BAG)).otherwise(bag(k=text(F.col("p_type"))).cast(BAG)).alias("properties"))
    return p.where(Filter("k", "isNull").on(F.col("properties"))).select("id", F.when(F.size("properties") == 0, "absent").otherwise("null").alias("how"))


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE contains(lower(p_type), 'ro')")
def filter_contains_ci(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)).vertices
    return v.where(Filter("kind", "contains", "Ro").on(F.col("properties"))).select("id")


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE CAST(p_size AS VARCHAR) = '7'")
def filter_eq_text(spark: SparkSession, d: str) -> DataFrame:
    """The text "7" in every size's place: the number 7 is no match for it, the text is."""
    both = _table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), bag(t=text(F.col("p_size").cast("string")), n=number(F.col("p_size"))).cast(BAG).alias("properties"))
    p = F.col("properties")
    same = lambda key: F.coalesce(Filter(key, "eq", "7").on(p), F.lit(False))
    return both.where(same("t") & ~same("n")).select("id")


@query("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def uncovered_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no returned line points to."""
    back = _table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("RETURNS").alias("type"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("target_id"))
    return read.without_inbound(Graph(star_graph(spark, d, ("Order",), ("PLACED",)).vertices, back), ["Order"], ["RETURNS"]).select("id")


@query("SELECT p_type AS type, CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'removed' ELSE 'modified' END AS change FROM (SELECT DISTINCT p_type FROM part) WHERE p_type NOT IN ('PROMO') UNION ALL SELECT 'NEW', 'added'")
def vocabulary_diff(spark: SparkSession, d: str) -> DataFrame:
    old = _table(spark, d, "part").select(F.col("p_type").alias("type")).distinct().withColumn("version", F.lit(1))
    new = old.where("type not in ('LARGE', 'MEDIUM')").withColumn("version", F.when(F.col("type") == "PROMO", 1).otherwise(2)).unionByName(_rows(spark, "type string, version int", ("NEW", 1)))
    return vocabulary.diff(old, new)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_size % 2 = 0 THEN 'a,c' ELSE 'b' END AS keys FROM part")
def changed_keys(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    old = bag(a=literal(1), b=literal("x")).cast(BAG)
    new = F.when(even, bag(a=literal(2), b=literal("x"), c=literal(True)).cast(BAG)).otherwise(bag(a=literal(1), b=literal("y")).cast(BAG))
    return _table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.array_join(mutate.changed_keys(old, new), ",").alias("keys"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM customer")
def hits_with_storage(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return search.with_storage_order(c.where("id % 4 = 0").withColumn("score", F.lit(0.5)), c)


@query("SELECT c_custkey AS id, CAST(c_custkey % 10 AS DOUBLE) AS rank FROM customer WHERE c_custkey % 4 = 0")
def full_text_hits(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    keys = c.where("id % 4 = 0").select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("rank"))
    return search.full_text_join(c, keys.unionByName(keys.withColumn("rank", F.lit(-1.0))))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'und')) AS b FROM w), d AS (SELECT count(*) AS n, greatest(count(*) FILTER (a > 0), 1) AS da, greatest(count(*) FILTER (b > 0), 1) AS db FROM c)
SELECT doc_id, round(ln(1 + d.n / da) * a / greatest(c.n, 1) + ln(1 + d.n / db) * b / greatest(c.n, 1), 6) AS score FROM c, d WHERE a + b > 0""")
def token_relevance(spark: SparkSession, d: str) -> DataFrame:
    found = search.token_rank(_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"), "THE +und:[\"", id_col="doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT * FROM (VALUES ('none', 0), ('start', 1), ('steps', 2), ('limit', 1), ('projection', 2)) v(spec, problems)")
def specification_problems(spark: SparkSession, d: str) -> DataFrame:
    step = Step("out", ("PLACED",), repeat=Repeat(10))
    specs = {"none": Traversal("a"), "start": Traversal(), "steps": Traversal("a", steps=(step,) * 7), "limit": Traversal("a", limit=500), "projection": Traversal("a", projection=Projection(("id", "b"), "values"), return_mode="path")}
    return _rows(spark, "spec string, problems int", *[(k, len(problems(s))) for k, s in specs.items()])


@query("SELECT * FROM (VALUES ('one', 10), ('two', 100), ('repeat', 300), ('most', 10000)) v(spec, rows)")
def fan_out_estimates(spark: SparkSession, d: str) -> DataFrame:
    hop = Step("out")
    specs = {"one": (hop,), "two": (hop, hop), "repeat": (hop, Step("out", repeat=Repeat(3))), "most": (hop,) * 6}
    return _rows(spark, "spec string, rows int", *[(k, fan_out(Traversal("a", steps=s))) for k, s in specs.items()])


_SPEC = Traversal(start_id="customer:7", steps=(Step("out", ("PLACED",)), Step("out", ("CONTAINS",))), limit=5, offset=3)


@query("SELECT DISTINCT 'part:' || l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 ORDER BY id LIMIT 5 OFFSET 3")
def traverse_page(spark: SparkSession, d: str) -> DataFrame:
    return traverse.run(star_graph(spark, d), _SPEC).select("id")


@query(f"""{_VE}, o AS (SELECT * FROM E WHERE type = 'PLACED' AND source_id = 'customer:7'), l AS (SELECT E.* FROM E JOIN o ON E.source_id = o.target_id WHERE E.type = 'CONTAINS'),
a AS (SELECT 'vertex' AS kind, 'customer:7' AS id, 0 AS depth UNION ALL SELECT DISTINCT 'vertex', target_id, 1 FROM o UNION ALL SELECT DISTINCT 'edge', id, 1 FROM o UNION ALL SELECT DISTINCT 'vertex', target_id, 2 FROM l UNION ALL SELECT DISTINCT 'edge', id, 2 FROM l),
p AS (SELECT * FROM a ORDER BY depth, kind DESC, id LIMIT 50 OFFSET 3), e2 AS (SELECT * FROM E WHERE id IN (SELECT id FROM p WHERE kind = 'edge'))
SELECT 'edge' AS kind, id FROM e2 UNION ALL SELECT DISTINCT 'vertex', id FROM V WHERE id IN (SELECT id FROM p WHERE kind = 'vertex' UNION SELECT source_id FROM e2 UNION SELECT target_id FROM e2)""")
def traverse_all_page(spark: SparkSession, d: str) -> DataFrame:
    v, e = traverse.page_of_everything(star_graph(spark, d), Traversal(start_id="customer:7", steps=_SPEC.steps, return_mode="all", limit=50, offset=3))
    return v.select(F.lit("vertex").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query("SELECT 'nation:' || n_nationkey AS id, 'nation' AS level FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 7 UNION ALL SELECT 'region:' || n_regionkey, 'region' FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def traverse_emit_all(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer", "Nation", "Region"), ("IN_NATION", "IN_REGION"))
    out = traverse.terminal(g, Traversal(start_id="customer:7", steps=(Step("out", (), repeat=Repeat(2)),), emit_all=True))
    return out.select("id", F.lower("type").alias("level"))


@query("SELECT 'customer:7>order:' || o_orderkey AS path, c_name || '>Order:' || o_orderkey AS labels, 'PLACED' AS types FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = 7")
def paths_attached(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer", "Order"), ("PLACED",))
    p = traverse.attached(g, traverse.path_rows(g, Traversal(start_id="customer:7", steps=(Step("out", ("PLACED",)),), return_mode="path")))
    return p.select(F.array_join("vertex_path", ">").alias("path"), F.array_join(F.transform("vertices", lambda x: x["label"]), ">").alias("labels"), F.array_join(F.transform("edges", lambda x: x["type"]), ">").alias("types"))


@query("SELECT 'nation:' || n_nationkey AS id, CAST(1 AS BIGINT) AS out, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS inside FROM nation")
def summaries_attached(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Nation",), ("IN_REGION", "IN_NATION"))
    out = traverse.with_relationship_summary(g, g.vertices)
    return out.select("id", F.col("outgoing")["IN_REGION"].alias("out"), F.coalesce(F.col("incoming")["IN_NATION"], F.lit(0)).cast("long").alias("inside"))


@query("SELECT 'open' AS mode, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 3 AND b.n_nationkey = 8 UNION ALL SELECT 'strict', CAST(0 AS BIGINT)")
def paths_strict_ends(spark: SparkSession, d: str) -> DataFrame:
    """With types that the ends don't have: they are exempt unless the ends are strict."""
    g = star_graph(spark, d, ("Nation", "Region"), ("IN_REGION",))
    n = lambda strict: explore.paths(g, "nation:3", "nation:8", 2, "all_simple", entity_types=["Region"], strict_endpoints=strict).groupBy().agg(F.count(F.lit(1)).alias("n"))
    return n(False).select(F.lit("open").alias("mode"), "n").unionByName(n(True).select(F.lit("strict").alias("mode"), "n"))


_NEAR = "SELECT * FROM E WHERE type IN ('IN_REGION', 'TRADES_WITH', 'IN_NATION')"


@query(f"{_VE}, n AS ({_NEAR}), g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM n UNION ALL SELECT target_id FROM n) GROUP BY id ORDER BY degree DESC, id LIMIT 25) SELECT id FROM n WHERE source_id IN (SELECT id FROM g) AND target_id IN (SELECT id FROM g)")
def hub_edges(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.hub_graph(star_graph(spark, d, edge_types=("IN_REGION", "TRADES_WITH", "IN_NATION")), 25).edges.select("id")


@query("""SELECT 'order:' || o_orderkey AS object_id, strftime(o_orderdate, '%Y-%m-%d') AS "at" FROM orders WHERE o_custkey = 7 ORDER BY "at" DESC, object_id LIMIT 5 OFFSET 1""")
def timeline_page(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as relationships of it, the latest first."""
    g = star_graph(spark, d, ("Customer", "Order"), ("PLACED",))
    none = F.lit(None).cast("string")
    day = g.vertices.where("type = 'Order'").select(F.col("id").alias("target_id"), F.col("created_at").alias("day"))
    e = g.edges.join(day, "target_id").withColumn("id", F.col("target_id")).withColumn("provenance", F.struct(F.col("day").alias("created_at"), none.alias("modified_at")))
    v = g.vertices.withColumn("provenance", F.struct(F.lit("1900").alias("created_at"), none.alias("modified_at")))
    return timeline.timeline(Graph(v, e), "customer:7", 5, 1, kinds=("relationship_created",)).rows.select("object_id", "at")


# --- changes --------------------------------------------------------------------------------------------------------------

_TYPES = Vocabulary((EntityType("Customer", properties=(Property("segment", required=True), Property("nationkey", "number"), Property("acctbal", "number"))), EntityType("Order")), (RelationshipType("PLACED", sources=("Customer",), targets=("Order",)),), "1.0.0")


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'required' WHEN c_custkey % 3 = 2 THEN 'there' ELSE 'Customer:' || lower(replace(c_name, '#', '-')) || CASE WHEN c_custkey % 2 = 0 THEN '-2' ELSE '' END END AS result FROM customer")
def create_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Every third customer lacks its segment, another exists; the slugs of the even ones are taken."""
    v = star_graph(spark, d, ("Customer",), ("PLACED",)).vertices
    key = F.expr("cast(substring(id, 10) as long)")
    old = v.where(key % 3 == 2).withColumn("slug", F.lit(None).cast("string"))
    slug = F.concat(F.lit("Customer:"), F.lower(F.regexp_replace("label", "#", "-")))
    taken = v.where((key % 3 == 0) & (key % 2 == 0)).withColumn("slug", slug).withColumn("id", F.concat("id", F.lit("0000000")))
    g = Graph(old.unionByName(taken), spark.createDataFrame([], EDGE))
    new = v.withColumn("properties", F.when(key % 3 == 1, F.map_filter("properties", lambda k, _: k != "segment")).otherwise(F.col("properties")))
    out, refused = mutate.create_vertices(g, new, _TYPES)
    made = out.vertices.join(g.vertices.select("id"), "id", "left_anti").select("id", F.col("slug").alias("result"))
    return made.unionByName(refused.select("id", F.when(F.size("errors") > 0, F.col("errors")[0]["code"]).otherwise("there").alias("result")))


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'ada' END AS by, 'eve' AS creator FROM customer")
def stamped_updates(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Customer",), ("PLACED",)).vertices.withColumn("provenance", mutate.stamp("eve", "2024-01-01"))
    ids = v.where("cast(substring(id, 10) as long) % 2 = 0").select("id", F.upper("label").alias("label"))
    out = mutate.update_vertices(Graph(v, spark.createDataFrame([], EDGE)), ids, mutate.stamp("ada", "2024-02-02", previous=F.col("provenance")))
    return out.vertices.select("id", F.col("provenance.modified_by").alias("by"), F.col("provenance.created_by").alias("creator"))


@query("SELECT 'PLACED:' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'made' ELSE 'refused' END AS result FROM orders")
def create_relationships(spark: SparkSession, d: str) -> DataFrame:
    """A third of the new edges exists, a third has its ends the wrong way round."""
    g = star_graph(spark, d, ("Customer", "Order"), ("PLACED",))
    key = F.expr("cast(substring(id, 8) as long) % 3")
    new = g.edges.withColumns({"source_id": F.when(key == 2, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(key == 2, F.col("source_id")).otherwise(F.col("target_id"))})
    old = Graph(g.vertices, g.edges.where(key == 1))
    out, refused = mutate.create_relationships(old, new, _TYPES)
    made = out.edges.join(old.edges.select("id"), "id", "left_anti").select("id", F.lit("made").alias("result"))
    return made.unionByName(refused.select("id", F.lit("refused").alias("result")))


@query("SELECT 'PLACED:' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def delete_relationships(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Order",), ("PLACED",))
    gone = _table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("PLACED:"), F.col("o_orderkey").cast("string")).alias("id"))
    return mutate.delete_relationships(g, gone).edges.select("id")


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'deleted' ELSE 'not_found' END AS status FROM customer")
def deletion_report(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer",), ("PLACED",))
    there = g.vertices.where("cast(substring(id, 10) as long) % 2 = 0")
    return mutate.deletion_report(Graph(there, g.edges), g.vertices.select("id"))


@query("SELECT 'region:' || r_regionkey AS id, 'vertex' AS kind FROM region UNION ALL SELECT 'customer:' || c_custkey, 'vertex' FROM customer WHERE false")
def type_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Without the type Nation no nation and none of their edges is left."""
    left = vocabulary.without_type(star_graph(spark, d, ("Nation", "Region"), ("IN_REGION", "TRADES_WITH")), "Nation")
    return left.vertices.select("id", F.lit("vertex").alias("kind")).unionByName(left.edges.select("id", F.lit("edge").alias("kind")))


# --- the vocabulary -------------------------------------------------------------------------------------------------------


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'type' WHEN p_partkey % 3 = 1 THEN 'unknown_property' END AS code FROM part")
def patch_validation(spark: SparkSession, d: str) -> DataFrame:
    """Updates need no required property; nulls delete."""
    t = EntityType("Part", properties=(Property("brand", required=True), Property("size", "number")))
    k = F.col("p_partkey") % 3
    patch = F.when(k == 0, bag(size=literal("big")).cast(BAG)).when(k == 1, bag(colour=literal("red")).cast(BAG)).otherwise(bag(size=literal(None)).cast(BAG))
    return _table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.get(vocabulary.patch_errors(patch, t), F.lit(0))["code"].alias("code"))


@query("SELECT * FROM (VALUES ('good', 0), ('bad name', 1), ('kind', 1), ('embedded', 1)) v(name, problems)")
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    cases = {"good": Property("a"), "bad name": Property("1 a"), "kind": Property("a", "colour"), "embedded": Property("a", "number", embeddable=True)}
    return _rows(spark, "name string, problems int", *[(k, len(vocabulary.property_problems(p))) for k, p in cases.items()])


@query("SELECT * FROM (VALUES ('closest', 'Customer'), ('similar', 'Customer'), ('none', NULL)) v(what, type)")
def type_suggestions(spark: SparkSession, d: str) -> DataFrame:
    types = [t.type for t in _TYPES.entity_types]
    like = vocabulary.similar_types("Customers", types)
    return _rows(spark, "what string, type string", ("closest", vocabulary.closest_type("custom", types)), ("similar", like[0][0]), ("none", vocabulary.closest_type("Planet", types)))


@query("SELECT * FROM (VALUES ('locked', 'rejected', '1.0.0'), ('like', 'rejected', '1.0.0'), ('name', 'rejected', '1.0.0'), ('managed', 'pending', '1.0.0'), ('add', 'applied', '1.1.0'), ('edit', 'applied', '1.1.0'), ('delete', 'applied', '2.0.0')) v(what, status, version)")
def governance(spark: SparkSession, d: str) -> DataFrame:
    new = Proposal("add", entity=EntityType("Planet"))
    cases = {
        "locked": (new, Governance("locked")), "like": (Proposal("add", entity=EntityType("Customers")), Governance()), "name": (Proposal("add", entity=EntityType("1 x")), Governance()),
        "managed": (new, Governance("managed", True)), "add": (new, Governance()), "edit": (Proposal("edit", entity=EntityType("Order", "new")), Governance()), "delete": (Proposal("delete", name="Order"), Governance()),
    }
    done = {k: vocabulary.decide(_TYPES, p, g) for k, (p, g) in cases.items()}
    return _rows(spark, "what string, status string, version string", *[(k, x.status, x.vocabulary.version) for k, x in done.items()])


@query("SELECT * FROM (VALUES ('edit', 'b:number,c:string'), ('migrate', 'Customer,Order,Planet'), ('version', '1.1.0'), ('reject', 'unknown types: Planet')) v(what, result)")
def vocabulary_edits(spark: SparkSession, d: str) -> DataFrame:
    merged = vocabulary.merged_properties((Property("a"), Property("b")), remove=["a"], update=[Property("b", "number")], add=[Property("b"), Property("c")])
    source = Vocabulary((EntityType("Planet"),), (), "1.0.0")
    moved = vocabulary.migrate(source, _TYPES)
    try:
        refused = vocabulary.migrate(source, _TYPES, "reject").version
    except ValueError as error:
        refused = str(error)
    return _rows(spark, "what string, result string", ("edit", ",".join(f"{p.name}:{p.type}" for p in merged)), ("migrate", ",".join(t.type for t in moved.entity_types)), ("version", moved.version), ("reject", refused))


@query("SELECT * FROM (VALUES ('Place', 'city'), ('Place', 'town')) v(type, value)")
def controlled_values(spark: SparkSession, d: str) -> DataFrame:
    doc = "# V\n## Entity Types\n### Place\nSomewhere.\n\n| Allowed value | Meaning |\n|---|---|\n| `city` | x |\n| `town` | y |\n"
    return _rows(spark, "type string, value string", *[(t, v) for t, values in vocabulary_markdown.controlled_values(doc).items() for v in values])


# --- reviews and planning -------------------------------------------------------------------------------------------------


@query("SELECT p_brand AS source, count(*) FILTER (p_size % 4 < 2) AS confirmed, count(*) FILTER (p_size % 4 = 2) AS corrected, count(*) FILTER (p_size % 4 = 3) AS hallucinated, round(count(*) FILTER (p_size % 4 < 3) / count(*), 4) AS accuracy, CASE WHEN count(*) FILTER (p_size % 4 = 3) > 0 THEN 'hallucinated' WHEN count(*) FILTER (p_size % 4 = 2) > 0 THEN 'corrected' ELSE 'confirmed' END AS overall FROM part GROUP BY p_brand")
def verdict_rates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    items = _table(spark, d, "part").select(F.col("p_brand").alias("source"), F.lit("entity").alias("type"), F.when(k < 2, "confirmed").when(k == 2, "corrected").otherwise("hallucinated").alias("verdict"))
    return extraction.verdict_rates(items).select("source", "confirmed", "corrected", "hallucinated", "accuracy", "overall")


_CODES = "WITH i AS (SELECT p_brand AS source, CASE WHEN p_size = 1 THEN 'missing-end' WHEN p_size < 10 THEN 'no-refs' END AS code FROM part), v AS (SELECT source, CASE WHEN bool_or(coalesce(code = 'missing-end', false)) THEN 'fail' WHEN bool_or(code IS NOT NULL) THEN 'warnings' ELSE 'pass' END AS verdict FROM i GROUP BY source)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.col("p_brand").alias("source"), F.when(F.col("p_size") == 1, "missing-end").when(F.col("p_size") < 10, "no-refs").alias("code"))
    return extraction.verdicts(p, p.where("code is not null"))


@query(f"{_CODES} SELECT source, verdict FROM v")
def tier1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(f"{_CODES} SELECT count(*) AS documents, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'warnings') AS warnings, CASE WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (verdict = 'warnings') > 0 THEN 'warnings' ELSE 'pass' END AS verdict FROM v")
def checkpoint_verdict(spark: SparkSession, d: str) -> DataFrame:
    return extraction.checkpoint(_verdicts(spark, d)).drop("accuracy")


@query("SELECT 'n' || n_nationkey AS source, round(100.0 * (n_nationkey % 3) / 10, 2) AS share, CASE WHEN n_nationkey % 5 = 0 THEN 'needs-work' WHEN n_nationkey % 3 = 0 THEN 'good' WHEN n_nationkey % 3 = 1 THEN 'acceptable' ELSE 'needs-work' END AS rating FROM nation")
def truncation_rating(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = _table(spark, d, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("source"), (k % 3).alias("truncated_chunks"), F.lit(10).alias("total_chunks"), (k % 5 == 0).cast("int").alias("unsalvageable_chunks"))
    return extraction.truncation(rows).select("source", "share", "rating")


@query("SELECT n_name AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS worker FROM nation")
def best_workers(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    trial = lambda worker, tier: n.select(F.col("n_name").alias("source"), F.lit(worker).alias("worker"), tier.alias("tier"), F.lit(50.0).alias("coverage"), F.lit(1.0).alias("orphan_percent"), F.lit(0).alias("duplicates"))
    return planning.compare_workers(trial("a", F.lit(1)).unionByName(trial("b", (F.col("n_nationkey") % 2 * 2).cast("int")))).select("source", "worker")


@query("SELECT n_name AS source, CASE n_regionkey % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'large' ELSE 'large' END AS next_worker FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_name, NULL FROM nation WHERE n_regionkey >= 2")
def next_workers(spark: SparkSession, d: str) -> DataFrame:
    workers = _rows(spark, "name string, capabilities array<string>, context_window int, max_output int, input_cost double, output_cost double, ord int", ("small", ["x"], 8000, 1000, 1.0, 1.0, 0), ("large", ["x"], 90000, 1000, 9.0, 9.0, 1))
    r = F.col("n_regionkey")
    failed = _table(spark, d, "nation").select(F.col("n_name").alias("source"), F.when(r < 2, "small").otherwise("large").alias("worker"), F.array(F.when(r < 2, "small").otherwise("large")).alias("tried"), F.lit("context length").alias("error"))
    return planning.reassign(failed, workers).select("source", "next_worker")


@query("SELECT CAST(count(*) AS BIGINT) AS items, CAST(ceil(count(*) / 10) AS BIGINT) AS batches, round(count(*) * (1500 * 1.0 + 200 * 5.0) / 1e6, 2) AS cost FROM part")
def validation_cost(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "part").count()
    cost = planning.validation_cost(n, 1.0, 5.0)
    return _rows(spark, "items long, batches long, cost double", (n, cost["batches"], cost["cost"]))


@query("SELECT p_brand AS source, p_partkey AS key FROM part WHERE p_partkey % 2 = 1 AND contains(p_brand, '#1')")
def items_left(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("key"))
    return planning.not_done(p, p.where("key % 2 = 0"), ["#1"])


@query("SELECT count(*) FILTER (n_regionkey < 2) AS converted, count(*) FILTER (n_regionkey = 2) AS skipped, count(*) FILTER (n_regionkey > 2) AS failed, CAST(coalesce(sum(n_nationkey) FILTER (n_regionkey < 2), 0) AS BIGINT) AS bytes FROM nation")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("n_regionkey")
    return planning.conversion_summary(_table(spark, d, "nation").select(F.when(r < 2, "converted").when(r == 2, "skipped").otherwise("failed").alias("status"), F.col("n_nationkey").cast("long").alias("bytes")))


@query("WITH s AS (SELECT 'r' || n_regionkey AS source, n_name AS name, n_nationkey AS last_seen, sum(length(n_name) + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC, n_name) AS held FROM nation WHERE n_nationkey <= 20 AND n_nationkey > 5) SELECT source, name FROM s WHERE held <= 25")
def recent_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("last_seen"), F.col("n_name").alias("text"))
    return planning.recent_context(rows, 20, 15, 25).select("source", "name")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS content FROM documents WHERE text IS NOT NULL")
def source_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", lines.span_text(F.col("text"), F.lit(2), F.lit(4)).alias("content"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS ord FROM nation WHERE n_regionkey IN (0, 2) OR n_nationkey = 1")
def selected_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The first member of two groups and one without a group are chosen."""
    n = _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.when(F.col("n_regionkey").isin(0, 2), F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))).alias("grp"))
    return corrections.with_groups(n.where("ord in (0, 2, 1)"), n).select("ord")


# --- documents with a layout ----------------------------------------------------------------------------------------------


def _manuals(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown text for each nation: a heading, a part of its own size, a table, and a second part."""
    k = F.col("n_nationkey")
    return _table(spark, d, "nation").select(k.cast("long").alias("doc_id"), F.concat(F.lit("# "), "n_name", F.lit("\n"), F.repeat(F.lit("x"), 300 + k), F.lit("\n## Data\n| a | b |\n|---|---|\n| 1 | "), k.cast("string"), F.when(k % 2 == 0, " |\n| 3 |\n").otherwise(" |\n| 3 | 4 |\n"), F.repeat(F.lit("y"), 300)).alias("text"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 0 AS index, '# ' || n_name AS heading, 1 AS level, 1 AS line_start, 2 AS line_end, '# ' || n_name || chr(10) || repeat('x', 300 + n_nationkey) AS content FROM nation
UNION ALL SELECT n_nationkey, 1, '## Data', 2, 3, 8, '## Data' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || n_nationkey || ' |' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '| 3 |' ELSE '| 3 | 4 |' END || chr(10) || repeat('y', 300) FROM nation""")
def manual_chapters(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_chapters(_manuals(spark, d), 500)


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS title, n_name || chr(10) || '  Data' AS structure, CAST(2 AS BIGINT) AS chapters FROM nation")
def manual_overviews(spark: SparkSession, d: str) -> DataFrame:
    docs = _manuals(spark, d)
    return lines.overview(lines.split_chapters(docs, 500), docs.select("doc_id", F.lit("a/b.md").alias("path")))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, line, level, heading, CASE WHEN line = 1 THEN NULL END::INTEGER AS section_end FROM nation, (VALUES (1, 1, ''), (3, 2, 'Data')) v(line, level, h), LATERAL (SELECT CASE WHEN line = 1 THEN n_name ELSE h END AS heading)")
def manual_headings(spark: SparkSession, d: str) -> DataFrame:
    return lines.headings(_manuals(spark, d))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, line, string_split('## Data' || chr(10) || '| a | b |', chr(10))[line - 2] AS content FROM nation, (VALUES (3), (4)) v(line)")
def manual_section(spark: SparkSession, d: str) -> DataFrame:
    return lines.read_section(_manuals(spark, d), "data", 2).select("doc_id", "line", "content")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 1 AS tables, CASE WHEN n_nationkey % 2 = 0 THEN 'suspect' ELSE 'clean' END AS verdict FROM nation")
def manual_tables(spark: SparkSession, d: str) -> DataFrame:
    return lines.detect_tables(_manuals(spark, d)).select("doc_id", "tables", "verdict")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 7 AS line, '| 1 | ' || n_nationkey || ' |' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '| 3 |' ELSE '| 3 | 4 |' END || chr(10) || repeat('y', 300) AS context FROM nation")
def manual_grep(spark: SparkSession, d: str) -> DataFrame:
    return lines.grep(_manuals(spark, d), r"^\| 3", 1).select("doc_id", F.col("line").cast("int").alias("line"), "context")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, i AS index, CASE i WHEN 0 THEN 0 ELSE 1 END AS line_offset, CASE i WHEN 0 THEN '1' || chr(9) || 'a' || n_nationkey || chr(10) || '2' || chr(9) || repeat('b', 60) ELSE '2' || chr(9) || repeat('b', 60) || chr(10) || '3' || chr(9) || repeat('c', 30) END AS content FROM nation, (VALUES (0), (1)) v(i)")
def manual_chunks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    docs = _table(spark, d, "nation").select(k.cast("long").alias("doc_id"), F.concat(F.lit("a"), k.cast("string"), F.lit("\n"), F.repeat(F.lit("b"), 60), F.lit("\n"), F.repeat(F.lit("c"), 30)).alias("text"))
    return lines.split_chunks(docs, 90, 20)


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 THEN CASE WHEN true THEN to_json(text) || '>1' END ELSE to_json(text) || '>2' END AS found FROM c""")
def salvaged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two entities over all turns and whole texts: whole, fenced, or cut off within the second entity. The
    first label and the number of entities that are left."""
    c = _table(spark, d, "conversations").where("text is not null")
    one = F.to_json(F.struct(F.col("text").alias("label")))
    whole = F.concat(F.lit('{"entities": ['), one, F.lit(", "), one, F.lit('], "relationships": []}'))
    cut = F.concat(F.lit('{"entities": ['), one, F.lit(', {"label": "cut o'))
    k = F.col("conv_id") % 3
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(cut)
    got = F.from_json(lines.salvaged(answer), "struct<entities:array<struct<label:string>>>")
    return c.select("conv_id", "turn", got.alias("g")).select("conv_id", "turn", F.expr("substring(to_json(struct(g.entities[0].label as l)), 6)").alias("l"), F.size("g.entities").alias("n")).select("conv_id", "turn", F.concat(F.expr("substring(l, 1, length(l) - 1)"), F.lit(">"), F.col("n").cast("string")).alias("found"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS source, count(*) AS entities, min(c_name) AS gold, 'applied,failed' AS report FROM customer GROUP BY c_nationkey")
def corrected_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers as an extraction: its first one gets a tier, one that isn't there is to be deleted."""
    c = _table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("source"), F.col("c_name").alias("label"))
    x = c.groupBy("source").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("label", F.lit("Customer").alias("type")))).alias("entities"), F.array().cast("array<struct<a:string>>").alias("relationships"))).alias("extraction"))
    fixes = [{"item": "entity", "operation": "update", "property": "tier", "value": "gold"}, {"item": "entity", "operation": "delete", "label": "nobody"}]
    first = c.groupBy("source").agg(F.min("label").alias("label"))
    fix = first.select("source", F.lit(0).alias("ord"), F.concat(F.lit(json.dumps(fixes[0])[:-1] + ', "label": "'), "label", F.lit('"}')).alias("correction")).unionByName(first.select("source", F.lit(1).alias("ord"), F.lit(json.dumps(fixes[1])).alias("correction")))
    done = corrections.apply_corrections(x, fix).select("source", F.from_json("extraction", "struct<entities:array<struct<label:string,properties:map<string,string>>>>").alias("x"), F.from_json("report", "array<array<string>>").alias("r"))
    return done.select("source", F.size("x.entities").cast("long").alias("entities"), F.filter("x.entities", lambda e: e["properties"]["tier"] == "gold")[0]["label"].alias("gold"), F.array_join(F.transform("r", lambda r: r[1]), ",").alias("report"))
