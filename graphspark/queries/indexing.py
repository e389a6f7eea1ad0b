"""Queries of search, vocabulary, extraction checks, resolution, planning and time, with their SQL where there is any.

Extractions are derived from the star schema by rule: parts are entities of their brand's source, lineitems
relationships; every so often a row gets a fault, by its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions.names import label_key, screaming_snake, type_name
from graphspark.functions.props import bag, literal, number, text
from graphspark.functions.similarity import cosine, jaro_winkler
from graphspark.model import BAG, EntityType, Graph, Property, RelationshipType, Vocabulary
from graphspark.operators import extraction, planning, resolve, search, timeline, vocabulary
from graphspark.operators import text as lines
from graphspark.plans.scratch import size_checked
from graphspark.sources.star_graph import star_graph
from graphspark.streaming.incremental import event_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- search ---------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT doc_id, (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'sch') AS INTEGER) + CAST(contains(lower(text), 'ción') AS INTEGER)) / 3.0 AS score FROM documents) SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score > 0")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return search.keyword_search(docs, F.lower("text"), "the sch ción").select("doc_id", F.round("score", 6).alias("score"))


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'under')")
def token_search(spark: SparkSession, d: str) -> DataFrame:
    return search.token_search(_table(spark, d, "documents"), F.col("text"), "under").select("doc_id")


@query("""WITH d AS (SELECT doc_id, substring(text, 1, 200) AS text FROM documents), h AS (SELECT doc_id, text, instr(lower(text), 'und') - 1 AS p FROM d), c AS (SELECT *, greatest(0, p - 40) AS lo, least(length(text), p + 43) AS hi FROM h WHERE p >= 0)
SELECT doc_id, (CASE WHEN lo > 0 THEN '...' ELSE '' END) || substring(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)) || (CASE WHEN hi < length(text) THEN '...' ELSE '' END) AS snippet FROM c""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", search.highlight(F.col("text"), "und").alias("snippet")).where("snippet is not null")


def _vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.1")
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.concept_search(_table(spark, d, "embeddings"), _vector(spark, d), 0.1, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 50")
def concept_search_top(spark: SparkSession, d: str) -> DataFrame:
    found = search.concept_search(_table(spark, d, "embeddings"), _vector(spark, d), -1.0, 50, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e JOIN (SELECT label, embedding, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q ON q.label = e.label")
def cosine_to_first(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(F.broadcast(first), "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("first")), 6).alias("score"))


@query("SELECT 'part:' || p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_type AS txt FROM part")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)).vertices
    return v.select("id", search.embedding_text(F.col("label"), F.col("summary"), F.col("properties"), ["kind", "absent"]).alias("txt"))


@query("""WITH c AS (SELECT p_partkey AS k, (i - 1) % 8 AS pos, sum(unicode(p_name[i]) / 128.0) AS v FROM part, range(1, 60) r(i) WHERE i <= length(p_name) GROUP BY ALL), n AS (SELECT k, sqrt(sum(v * v)) AS norm FROM c GROUP BY k)
SELECT 'part:' || k AS id, CAST(pos AS INTEGER) AS pos, round(CAST(v / norm AS DOUBLE), 3) AS value FROM c JOIN n USING (k)""")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = star_graph(spark, d, ("Part",), ("SUPPLIED_BY",)).vertices
    rows = v.select("id", F.posexplode(search.embedder()(F.col("label"))).alias("pos", "v")).where("v <> 0")
    return rows.select("id", "pos", F.round(F.col("v").cast("double"), 3).alias("value"))


# --- names ----------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_type AS name, upper(replace(p_type, ' ', '_')) AS snake FROM part")
def screaming_snake_names(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_type").alias("name")).distinct().select("name", screaming_snake(F.col("name")).alias("snake"))


@query("SELECT c_name AS name, regexp_replace(regexp_replace(lower(trim(c_name)), '[-\\s.]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS normal FROM customer")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_name").alias("name"), type_name(F.col("c_name")).alias("normal"))


@query("SELECT r_name AS name, 'e ' || lower(r_name) || '-x/y' AS key FROM region")
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    r = _table(spark, d, "region")
    return r.select(F.col("r_name").alias("name"), label_key(F.concat(F.lit(" É  "), "r_name", F.lit(" -  X / y "))).alias("key"))


_JW = "j + least(4, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE 4 END) * 0.1 * (1 - j)"
_PAIRS = "WITH n AS (SELECT DISTINCT p_type AS t FROM part), p AS (SELECT x.t AS a, y.t AS b, jaro_similarity(x.t, y.t) AS j FROM n x, n y)"


@query(f"{_PAIRS} SELECT a, b, round({_JW}, 6) AS score FROM p WHERE a < b")
def jaro_winkler_names(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select("p_type").distinct()
    return p.select(F.col("p_type").alias("a")).crossJoin(size_checked(p.select(F.col("p_type").alias("b")))).where("a < b").select("a", "b", F.round(jaro_winkler("a", "b"), 6).alias("score"))


@query(f"{_PAIRS} SELECT a, b, round({_JW}, 6) AS score FROM p WHERE {_JW} >= 0.9")
def type_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    return resolve.similar_names(p, p, 0.9).select("a", "b", F.round("score", 6).alias("score"))


# --- vocabulary -----------------------------------------------------------------------------------------------------

_BRANDS = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23", "Brand#31", "Brand#32", "Brand#33")
VOCABULARY = Vocabulary(
    (
        EntityType("Part", properties=(Property("brand", "enum", True, values=_BRANDS), Property("size", "number"), Property("kind"), Property("price", "number"))),
        EntityType("Nation"),
    ),
    (RelationshipType("IN_NATION", sources=("Customer",), targets=("Nation",)), RelationshipType("TRADES_WITH", sources=("Nation",), targets=("Nation",), bidirectional=True)),
    "1.0.0",
)


def _faulty_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with faults by key: no brand, a text for the size, an unknown key, a blank label, an unknown type."""
    p = _table(spark, d, "part")
    k = F.col("p_partkey")
    props = F.map_concat(
        F.when(k % 7 == 0, F.create_map().cast(BAG)).otherwise(bag(brand=text(F.col("p_brand"))).cast(BAG)),
        F.when(k % 11 == 0, bag(size=literal("big"))).otherwise(bag(size=number(F.col("p_size")))).cast(BAG),
        F.when(k % 13 == 0, bag(colour=literal("red")).cast(BAG)).otherwise(F.create_map().cast(BAG)),
    )
    return p.select(F.concat(F.lit("part:"), k.cast("string")).alias("id"), F.when(k % 17 == 0, "Thing").otherwise("Part").alias("type"), F.when(k % 19 == 0, " ").otherwise(F.col("p_name")).alias("label"), props.alias("properties"))


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand AS b FROM part), g AS (SELECT * FROM p WHERE k % 17 <> 0 AND k % 19 <> 0)
SELECT 'part:' || k AS id, 'unknown_type' AS code, 'Thing' AS field FROM p WHERE k % 17 = 0
UNION ALL SELECT 'part:' || k, 'label', 'label' FROM p WHERE k % 17 <> 0 AND k % 19 = 0
UNION ALL SELECT 'part:' || k, 'required', 'brand' FROM g WHERE k % 7 = 0
UNION ALL SELECT 'part:' || k, 'enum', 'brand' FROM g WHERE k % 7 <> 0 AND b NOT IN {_BRANDS}
UNION ALL SELECT 'part:' || k, 'type', 'size' FROM g WHERE k % 11 = 0
UNION ALL SELECT 'part:' || k, 'unknown_property', 'colour' FROM g WHERE k % 13 = 0""")
def validate_entities(spark: SparkSession, d: str) -> DataFrame:
    v = _faulty_parts(spark, d)
    return vocabulary.audit_entities(Graph(v, v), VOCABULARY)


@query("""SELECT 'IN_NATION:s:supplier:' || s_suppkey AS id, 'source_type' AS code, 'Supplier' AS field FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'IN_NATION:s:supplier:' || s_suppkey, 'missing_source', 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0""")
def validate_relationships(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Customer", "Supplier", "Nation"), ("IN_NATION", "TRADES_WITH"))
    kept = g.vertices.where(~((F.col("type") == "Supplier") & (F.expr("cast(substring(id, 10) as long)") % 5 == 0)))
    return vocabulary.audit_relationships(Graph(kept, g.edges), VOCABULARY).withColumn("id", F.regexp_replace("id", "^IN_NATION:s:(supplier:)?", "IN_NATION:s:supplier:"))


@query("""SELECT 'Part' AS type, name, kind, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'brand' AS name, 'string' AS kind FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 7 <> 0 UNION ALL SELECT 'size', 'mixed' FROM part WHERE p_partkey % 17 <> 0 UNION ALL SELECT 'colour', 'string' FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 = 0) GROUP BY ALL""")
def infer_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.infer_properties(_faulty_parts(spark, d).where("type = 'Part'"))


# --- extractions ------------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities of the source that their brand is; labels and properties have faults by key."""
    p, k = _table(spark, d, "part"), F.col("p_partkey")
    label = F.when(k % 10 == 0, F.concat(F.lit("L"), (k % 40).cast("string"))).when(k % 23 == 0, "{x").when(k % 29 == 0, "12345").otherwise(F.concat("p_name", F.lit(" "), k.cast("string")))
    props = F.when(k % 8 == 0, F.create_map().cast(BAG)).otherwise(bag(size=number(F.col("p_size")), price=text(F.concat(F.col("p_retailprice").cast("int").cast("string"), F.lit(" EUR")))).cast(BAG))
    refs = F.when(k % 31 == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.array(F.struct((k % 50 + 1).cast("int").alias("start"), (k % 50 + 3).cast("int").alias("end"))))
    return p.select(F.col("p_brand").alias("source"), k.alias("ord"), F.element_at(F.split("p_type", " "), 1).alias("type"), label.alias("label"), F.col("p_type").alias("summary"), props.alias("properties"), F.array(F.concat(F.lit("A"), k.cast("string"))).alias("aliases"), refs.alias("refs"))


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as relationships from a part's alias to that of the next line, or to nothing."""
    l = _table(spark, d, "lineitem").join(_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")  # noqa: E741
    target = F.when(F.col("l_suppkey") % 9 == 0, F.lit("nobody")).otherwise(F.concat(F.lit("a"), F.col("l_partkey").cast("string")))
    start = (F.col("l_partkey") % 4 + 1).cast("int")
    return l.select(F.col("p_brand").alias("source"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("ord"), F.lit("USES").alias("type"), F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("source_label"), target.alias("target_label"), F.array(F.struct(start.alias("start"), (start + 2).alias("end"))).alias("refs"), F.create_map().cast(BAG).alias("properties")).dropDuplicates(["ord"])


_E = """E AS (SELECT p_brand AS source, p_partkey AS ord, split_part(p_type, ' ', 1) AS type, CASE WHEN p_partkey % 10 = 0 THEN 'L' || (p_partkey % 40) WHEN p_partkey % 23 = 0 THEN '{x' WHEN p_partkey % 29 = 0 THEN '12345' ELSE p_name || ' ' || p_partkey END AS label, p_partkey % 8 = 0 AS bare, p_size, CAST(trunc(p_retailprice) AS BIGINT) AS price FROM part)"""
_R = """R AS (SELECT DISTINCT p_brand AS source, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_partkey, l_suppkey % 9 = 0 AS lost, l_partkey % 4 + 1 AS start FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"WITH {_E} SELECT source, count(*) FILTER (bare) AS bare, count(*) AS total, round(100.0 * count(*) FILTER (bare) / count(*), 2) AS share, CASE WHEN 100 - round(100.0 * count(*) FILTER (bare) / count(*), 2) >= 95 THEN 'good' WHEN 100 - round(100.0 * count(*) FILTER (bare) / count(*), 2) >= 90 THEN 'acceptable' ELSE 'needs-work' END AS rating FROM E GROUP BY source")
def property_coverage(spark: SparkSession, d: str) -> DataFrame:
    return extraction.property_coverage(_entities(spark, d))


@query(f"WITH {_R}, s AS (SELECT source, count(*) FILTER (lost) AS orphans, count(*) AS total, round(100.0 * count(*) FILTER (lost) / count(*), 2) AS share FROM R GROUP BY source) SELECT *, CASE WHEN share <= 2 THEN 'good' WHEN share <= 5 THEN 'acceptable' ELSE 'needs-work' END AS rating FROM s")
def orphan_rate(spark: SparkSession, d: str) -> DataFrame:
    return extraction.orphan_rate(_entities(spark, d), _relationships(spark, d))


@query(f"WITH {_E} SELECT source, lower(type) AS type, lower(trim(label)) AS key, count(*) AS n FROM E GROUP BY ALL HAVING count(*) > 1")
def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    return extraction.duplicate_labels(_entities(spark, d))


@query("""WITH r AS (SELECT DISTINCT p_name AS l FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 50 = 0), w AS (SELECT l, list_distinct(string_split(lower(l), ' ')) AS w FROM r)
SELECT 'all' AS source, 'Part' AS type, a.l AS sub, b.l AS sup FROM w a, w b WHERE len(a.w) < len(b.w) AND list_has_all(b.w, a.w)""")
def token_subset(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    rows = p.select(F.lit("all").alias("source"), F.lit("Part").alias("type"), F.col("p_name").alias("label")).union(p.where("p_partkey % 50 = 0").select(F.lit("all"), F.lit("Part"), F.element_at(F.split("p_name", " "), 1)))
    return extraction.token_subsets(rows)


@query(rf"WITH {_E} SELECT source, type, label, CASE WHEN length(label) <= 2 THEN 'too-short' WHEN label LIKE '%{{%' THEN 'json-artifact' ELSE 'numeric-only' END AS reason FROM E WHERE length(label) <= 2 OR label LIKE '%{{%' OR regexp_full_match(label, '[0-9]+')")
def label_quality(spark: SparkSession, d: str) -> DataFrame:
    return extraction.label_problems(_entities(spark, d))


@query("""WITH l AS (SELECT r_name AS type, lower(n_name) AS key, n_nationkey % 6 <> 5 AS listed FROM nation JOIN region ON r_regionkey = n_regionkey), s AS (SELECT type, count(*) AS labels, count(*) FILTER (listed) AS matched FROM l GROUP BY type)
SELECT type, labels, matched + 1 AS values, matched, round(matched / labels, 2) AS dominance, round(matched / (matched + 1), 2) AS coverage FROM s WHERE matched > 0 AND matched + 1 >= 4 AND matched / labels >= 0.8 AND matched / (matched + 1) >= 0.6""")
def enum_checklist(spark: SparkSession, d: str) -> DataFrame:
    """Nations as entities of their region's type, beside all customers; most nations' names, and one that no nation
    has, are their type's controlled values."""
    n = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    labels = n.select(F.col("r_name").alias("type"), F.col("n_name").alias("label")).unionByName(_table(spark, d, "customer").select(F.lit("Customer").alias("type"), F.col("c_name").alias("label")))
    listed = n.where("n_nationkey % 6 <> 5").select(F.col("r_name").alias("type"), F.lower("n_name").alias("value"))
    return extraction.enum_checklist(labels, listed.unionByName(n.select(F.col("r_name").alias("type"), F.lit("nowhere").alias("value")).distinct()))


@query(f"WITH {_R} SELECT source, CAST(start AS INTEGER) AS line_start, CAST(start + 2 AS INTEGER) AS line_end, count(*) AS n FROM R GROUP BY source, start HAVING count(*) >= 10")
def shared_citation(spark: SparkSession, d: str) -> DataFrame:
    return extraction.shared_citations(_relationships(spark, d))


@query(f"WITH {_E}, {_R} SELECT DISTINCT e.source, e.type, e.label, e.ord FROM E e JOIN R r ON r.source = e.source AND r.l_partkey = e.ord WHERE e.bare")
def zero_property_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return extraction.bare_endpoints(_entities(spark, d), _relationships(spark, d))


@query(f"""WITH {_E} SELECT source, type, label, 'size' AS property, 'above' AS code FROM E WHERE NOT bare AND type = 'STANDARD' AND p_size > 40
UNION ALL SELECT source, type, label, 'size', 'below' FROM E WHERE NOT bare AND type = 'STANDARD' AND p_size < 5
UNION ALL SELECT source, type, label, 'price', 'above' FROM E WHERE NOT bare AND type = 'PROMO' AND price > 1500""")
def tier1_range(spark: SparkSession, d: str) -> DataFrame:
    return extraction.range_issues(_entities(spark, d), [extraction.Range("STANDARD", "size", "integer", 5, 40), extraction.Range("PROMO", "price", "number", high=1500)])


@query(f"""WITH {_E}, {_R} SELECT source, 'unknown-entity-type' AS code, type AS subject FROM E WHERE type NOT IN ('STANDARD', 'PROMO')
UNION ALL SELECT source, 'missing-end', 'nobody' FROM R WHERE lost""")
def tier1_schema(spark: SparkSession, d: str) -> DataFrame:
    v = Vocabulary((EntityType("STANDARD"), EntityType("PROMO")), (RelationshipType("USES"),), "1.0.0")
    return extraction.schema_issues(_entities(spark, d), _relationships(spark, d), v)


@query(f"""WITH {_E}, {_R} SELECT source, 'no-refs' AS code, label AS subject FROM E WHERE ord % 31 = 0
UNION ALL SELECT source, 'duplicate', lower(type || ':' || label) FROM E GROUP BY source, lower(type || ':' || label) HAVING count(*) > 1
UNION ALL SELECT source, 'too-many-relationships', CAST(count(*) AS VARCHAR) FROM R GROUP BY source HAVING count(*) > 5""")
def tier1_structure(spark: SparkSession, d: str) -> DataFrame:
    return extraction.structure_issues(_entities(spark, d), _relationships(spark, d), most_relationships=5, no_orphans=False)


@query(f"""WITH {_E} SELECT source, type, lower(label) AS key, min(ord) AS ord, min_by(label, ord) AS label, count(*) AS n FROM E GROUP BY source, type, lower(label)""")
def intra_doc_dedup(spark: SparkSession, d: str) -> DataFrame:
    return extraction.merge_entities(_entities(spark, d)).select("source", "type", "key", "ord", "label", "n")


@query(f"WITH {_R} SELECT source, lower('A' || l_partkey) AS source_key, CASE WHEN lost THEN 'nobody' ELSE 'a' || l_partkey END AS target_key, min(ord) AS ord, count(*) AS n FROM R GROUP BY ALL")
def relationship_dedup(spark: SparkSession, d: str) -> DataFrame:
    return extraction.merge_relationships(_relationships(spark, d)).select("source", "source_key", "target_key", "ord", "n")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_name AS l FROM part), g AS (SELECT * FROM p WHERE k % 17 <> 0 AND k % 19 <> 0), f AS (
SELECT 'unknown-type' AS class FROM p WHERE k % 17 = 0 UNION ALL SELECT 'other' FROM p WHERE k % 17 <> 0 AND k % 19 = 0 UNION ALL SELECT 'required-property-missing' FROM g WHERE k % 7 = 0
UNION ALL SELECT 'closed-enum-value' FROM g WHERE k % 7 <> 0 AND b NOT IN {_BRANDS} UNION ALL SELECT 'other' FROM g WHERE k % 11 = 0 UNION ALL SELECT 'other' FROM g WHERE k % 13 = 0) SELECT class, count(*) AS n FROM f GROUP BY class""")
def conformance_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _faulty_parts(spark, d).withColumn("source", F.lit("all"))
    return extraction.class_counts(extraction.conformance(rows, VOCABULARY)).select("class", "n")


@query(f"SELECT 'Part' AS type, 'brand' AS property, p_brand AS value, count(*) AS n FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 7 <> 0 AND p_brand NOT IN {_BRANDS} GROUP BY p_brand HAVING count(*) >= 2")
def enum_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return extraction.enum_offenders(_faulty_parts(spark, d), VOCABULARY)


# --- resolution -------------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates of their brand's type; every fifth lends its neighbour an alias."""
    p, k = _table(spark, d, "part"), F.col("p_partkey")
    alias = F.when(k % 5 == 1, F.array(F.concat(F.lit("N"), (k - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    return p.select(F.lit("Part").alias("type"), k.alias("ord"), F.concat(F.lit("n"), k.cast("string")).alias("label"), F.col("p_brand").alias("summary"), alias.alias("aliases"), bag(size=number(F.col("p_size"))).cast(BAG).alias("properties"), F.col("p_brand").alias("source"))


_CANON = "CASE WHEN p_partkey % 5 = 1 AND p_partkey > (SELECT min(p_partkey) FROM part) THEN p_partkey - 1 ELSE p_partkey END"


@query(f"SELECT 'Part' AS type, p_partkey AS ord, {_CANON} AS canonical FROM part")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    return resolve.merge_candidates(_candidates(spark, d))


@query(f"SELECT 'Part' AS type, p_partkey AS ord, {_CANON} AS canonical FROM part")
def consolidate_connected(spark: SparkSession, d: str) -> DataFrame:
    return resolve.connected_candidates(_candidates(spark, d))


def _log(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    k = F.col("p_partkey")
    keys = lambda n, *names: F.slice(F.array(*[F.lit(x) for x in names]), 1, (k % n).cast("int"))
    return p.select(F.col("p_brand").alias("entity_type"), F.col("p_name").alias("canonical_label"), F.concat("p_name", k.cast("string")).alias("merged_label"), F.round(0.8 + (k % 20) / 100.0, 2).alias("confidence"), keys(4, "a", "b", "c").alias("canonical_property_keys"), F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("z"))).otherwise(keys(5, "a", "b", "c", "d")).alias("merged_property_keys"))


@query("WITH c AS (SELECT round(0.8 + (p_partkey % 20) / 100.0, 2) AS c FROM part), s AS (SELECT count(*) FILTER (c >= 0.95) AS high, count(*) FILTER (c < 0.95 AND c >= 0.9) AS medium, count(*) FILTER (c < 0.9) AS low FROM c) SELECT *, CASE WHEN low = 0 AND medium = 0 THEN 'good' WHEN low = 0 THEN 'acceptable' ELSE 'needs-work' END AS rating FROM s")
def merge_confidence(spark: SparkSession, d: str) -> DataFrame:
    return extraction.merge_confidence(_log(spark, d))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    p, k = _table(spark, d, "part"), F.col("p_partkey")
    return p.select(k.alias("id"), F.col("p_brand").alias("type"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("label"), F.array(F.concat(F.lit("x"), (k % 500).cast("string")), F.concat(F.lit("alias-"), (k % 700).cast("string"))).alias("aliases"), F.slice(F.array(F.lit("a.md"), F.lit("b.md"), F.lit("c.md")), 1, (k % 4).cast("int")).alias("source_documents"))


@query("""WITH a AS (SELECT p_brand AS type, p_name || ' ' || p_partkey AS label, unnest(['x' || (p_partkey % 500), 'alias-' || (p_partkey % 700)]) AS alias FROM part), t AS (SELECT alias, count(DISTINCT type) AS n FROM a GROUP BY alias)
SELECT type, label, a.alias, CASE WHEN length(a.alias) <= 4 THEN 'too-short' ELSE 'ambiguous-across-types' END AS reason FROM a JOIN t ON t.alias = a.alias WHERE length(a.alias) <= 4 OR n > 1""")
def alias_specificity(spark: SparkSession, d: str) -> DataFrame:
    return extraction.alias_specificity(_registry(spark, d))


@query("SELECT p_brand AS type, p_name || ' ' || p_partkey AS label, CAST(least(p_partkey % 4, 3) AS INTEGER) AS sources FROM part WHERE p_partkey % 4 >= 2")
def cross_source(spark: SparkSession, d: str) -> DataFrame:
    return extraction.cross_source(_registry(spark, d))


@query("""WITH k AS (SELECT p_brand AS entity_type, p_name AS canonical_label, p_name || p_partkey AS merged_label, list_slice(['a', 'b', 'c'], 1, p_partkey % 4) AS c, CASE WHEN p_partkey % 3 = 0 THEN ['x', 'a', 'y', 'z'] ELSE list_slice(['a', 'b', 'c', 'd'], 1, p_partkey % 5) END AS m FROM part),
j AS (SELECT *, len(list_intersect(c, m)) / len(list_distinct(list_concat(c, m))) AS o FROM k WHERE len(c) > 0 AND len(m) > 0) SELECT entity_type, canonical_label, merged_label, round(o, 2) AS overlap FROM j WHERE o < 0.3""")
def type_consistency(spark: SparkSession, d: str) -> DataFrame:
    return extraction.type_consistency(_log(spark, d))


@query("SELECT p_brand AS type, count(*) AS entries, count(*) AS merged, CAST(0.5 AS DOUBLE) AS rate FROM part GROUP BY p_brand")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return extraction.merge_rates(_registry(spark, d), _log(spark, d))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS type, p_name || ' ' || p_partkey AS name FROM part),
q AS (SELECT k AS key, type, CASE k % 4 WHEN 0 THEN upper(name) WHEN 1 THEN 'ALIAS-' || (k % 700) WHEN 2 THEN name || 'x' ELSE reverse(name) END AS label FROM p),
r AS (SELECT k AS entry, type, lower(name) AS low, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, ['x' || (k % 500), 'alias-' || (k % 700), lower(name)] AS names FROM p),
s AS (SELECT q.key, min(r.entry) AS entry, 1.0 AS c, 'slug' AS how FROM q JOIN r ON r.type = q.type AND r.slug = regexp_replace(regexp_replace(lower(q.label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') GROUP BY q.key),
a AS (SELECT q.key, min(r.entry) AS entry, 0.9 AS c, 'alias' AS how FROM q JOIN r ON r.type = q.type AND list_contains(r.names, lower(q.label)) WHERE q.key NOT IN (SELECT key FROM s) GROUP BY q.key),
j AS (SELECT q.key, r.entry, lower(q.label) AS a, r.low AS b, jaro_similarity(lower(q.label), r.low) AS j FROM q JOIN r ON r.type = q.type WHERE q.key NOT IN (SELECT key FROM s) AND q.key NOT IN (SELECT key FROM a)),
f AS (SELECT key, entry, """ + _JW + """ AS c, 'fuzzy' AS how FROM j WHERE """ + _JW + """ >= 0.9 QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, entry) = 1),
m AS (SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM f)
SELECT q.key, m.entry, m.how AS matched_by, round(CAST(m.c AS DOUBLE), 6) AS confidence FROM q LEFT JOIN m ON m.key = q.key""")
def registry_match(spark: SparkSession, d: str) -> DataFrame:
    p, k = _table(spark, d, "part"), F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), k.cast("string"))
    label = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(F.lit("ALIAS-"), (k % 700).cast("string"))).when(k % 4 == 2, F.concat(name, F.lit("x"))).otherwise(F.reverse(name))
    return resolve.match_registry(p.select(k.alias("key"), F.col("p_brand").alias("type"), label.alias("label")), _registry(spark, d)).select("key", "entry", "matched_by", F.round("confidence", 6).alias("confidence"))


@query("""WITH e AS (SELECT 'part:' || p_partkey AS id, 'a' || p_partkey AS name FROM part), r AS (SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_partkey, l_suppkey % 9 = 0 AS lost FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT ord, 'part:' || l_partkey AS source_id, CASE WHEN lost THEN NULL ELSE 'part:' || l_partkey END AS target_id FROM r""")
def resolve_relationships(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    ids = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Part").alias("type"), F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("label"), F.array().cast("array<string>").alias("aliases"))
    return resolve.resolve_relationships(_relationships(spark, d), ids, {"USES": (("Part",), ())}).select("ord", "source_id", "target_id")


# --- texts ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, 0 AS index, 'Document' AS heading, 1 AS line_start, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS line_end, CAST(length(coalesce(text, '')) AS INTEGER) AS n FROM documents")
def chapter_split(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_chapters(_table(spark, d, "documents"), 4000).select("doc_id", "index", "heading", "line_start", "line_end", F.length("content").alias("n"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, split_part(text, chr(10), CAST(i AS BIGINT)) AS content FROM documents, range(2, 5) r(i) WHERE i <= len(string_split(text, chr(10)))")
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.read_lines(_table(spark, d, "documents"), 2, 4)


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, string_split(text, chr(10))[i] AS content FROM documents, range(1, 5000) r(i) WHERE i <= len(string_split(text, chr(10))) AND regexp_matches(string_split(text, chr(10))[i], '(?i)tion\\w*\\.')")
def source_grep(spark: SparkSession, d: str) -> DataFrame:
    return lines.grep(_table(spark, d, "documents"), r"tion\w*\.").select("doc_id", "line", "content")


@query("SELECT doc_id, 0 AS tables, 'clean' AS verdict, '' AS reasons FROM documents")
def table_detection(spark: SparkSession, d: str) -> DataFrame:
    return lines.detect_tables(_table(spark, d, "documents"))


# --- planning and time --------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source, CASE WHEN doc_id % 2 = 0 THEN 'spec-sheet' ELSE 'om-manual' END AS type, CAST(ceil(n_chars * 30 / 4.0) AS BIGINT) AS tokens FROM documents),
w AS (SELECT * FROM (VALUES ('small', 'structured-extraction', 8000, 1000, 0.1, 0.4, 0), ('large', 'both', 100000, 8000, 3.0, 15.0, 1)) v(name, cap, cw, mo, ic, oc, ord)),
s AS (SELECT *, greatest(1, CAST(ceil(tokens / greatest(1, cw - 2000 - mo)) AS BIGINT)) AS chunks, cw - 2000 - mo AS room FROM d, w WHERE (cap = 'both' OR (type = 'spec-sheet' AND cap = 'structured-extraction')) AND (tokens <= 8000 OR cap = 'both' OR tokens <= cw - 2000 - mo)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY chunks, ic + oc, ord) = 1)
SELECT source, type, tokens, name AS worker, chunks, chunks * (2000 + least(tokens, room)) AS input_tokens FROM b""")
def worker_assign(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = _table(spark, d, "documents").select(k.cast("string").alias("source"), F.when(k % 2 == 0, "spec-sheet").otherwise("om-manual").alias("type"), planning.tokens_of(F.col("n_chars") * 30).alias("tokens"))
    workers = spark.createDataFrame([("small", ["structured-extraction"], 8000, 1000, 0.1, 0.4, 0), ("large", ["structured-extraction", "prose-extraction", "large-context"], 100000, 8000, 3.0, 15.0, 1)], "name string, capabilities array<string>, context_window int, max_output int, input_cost double, output_cost double, ord int")
    return planning.assign_workers(docs, workers).select("source", "type", "tokens", "worker", "chunks", "input_tokens")


@query("SELECT CASE WHEN count(*) = 0 THEN 'prepare' WHEN bool_and(o_orderstatus NOT IN ('O', 'F')) THEN 'complete' WHEN bool_or(o_orderstatus = 'O') THEN 'extract' ELSE 'extraction-review' END AS phase FROM orders")
def phase_detect(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "extracted").otherwise("excluded").alias("status"))
    return planning.phase(o)


@query("""WITH n AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) - 1 AS loc, count(*) OVER () AS c FROM part)
SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS id, CASE WHEN loc < floor(c / 6.0 + 0.5) THEN 0 WHEN loc < floor(c / 6.0 + 0.5) + floor(c * 2 / 6.0 + 0.5) THEN 1 ELSE 2 END AS worker FROM n""")
def weighted_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"))
    return planning.assign_ranges(p, [1, 2, 3]).select("id", "worker")


@query("""WITH p AS (SELECT p_brand AS source, p_name || ' ' || p_partkey AS label, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_brand || ':' || p_name || ' ' || p_partkey, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS u FROM part)
SELECT source, label, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS hash FROM p ORDER BY hash, source, label LIMIT (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) FROM part)""")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select(F.col("p_brand").alias("source"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"))
    return planning.sample(p)


@query("""SELECT 'entity_created' AS event, strftime(o_orderdate, '%Y-%m-%d') AS at, 'order:' || o_orderkey AS object_id, CAST(NULL AS VARCHAR) AS other_id FROM orders WHERE o_orderkey = 33
UNION ALL SELECT 'relationship_created', strftime(l_shipdate, '%Y-%m-%d'), 'CONTAINS:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'part:' || l_partkey FROM lineitem WHERE l_orderkey = 33""")
def timeline_of_order(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d, ("Order", "Part"), ("CONTAINS",))
    none = F.lit(None).cast("string")
    made = lambda at: F.struct(at.alias("created_at"), none.alias("modified_at"))
    v = g.vertices.withColumn("provenance", made(F.col("created_at")))
    e = g.edges.withColumn("provenance", made(F.col("properties")["shipped"]["s"]))
    return timeline.events(Graph(v, e), "order:33")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    out = event_counts(_table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
