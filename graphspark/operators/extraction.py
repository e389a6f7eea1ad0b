"""Checks and merges of extracted rows.

Entities: source, ord, type, label, summary, properties (bag), aliases (array), refs (array of start/end lines).
Relationships: source, ord, type, source_label, target_label, properties, refs. `ord` is the place in the extraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from graphspark.functions.names import label_key
from graphspark.functions.props import plain
from graphspark.functions.similarity import key_jaccard
from graphspark.model import Vocabulary
from graphspark.operators.vocabulary import entity_errors
from graphspark.plans.scratch import size_checked

EXAMPLES = 10


def rated(share: Column, good: float, fair: float, high_is_good: bool = True) -> Column:
    better = (lambda x: share >= x) if high_is_good else (lambda x: share <= x)
    return F.when(better(good), "good").when(better(fair), "acceptable").otherwise("needs-work")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 2)


# --- within a document ---------------------------------------------------------------------------------------------


def in_order(c: str) -> Column:
    """The values of a group by ord; maps have no order of their own."""
    by_ord = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", c)), by_ord), lambda x: x[c])


def earliest_wins(bags: Column) -> Column:
    """One bag from several, the first value of each key winning."""
    pairs = F.flatten(F.transform(bags, lambda b: F.map_entries(F.coalesce(b, F.create_map().cast("map<string,struct<s:string,d:double,b:boolean,j:string>>")))))
    first = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row for each source, type and label (case folded): the first label and properties, the longest summary
    (first on ties), all aliases and refs."""
    longest = F.max_by("summary", F.struct(F.length(F.coalesce("summary", F.lit(""))), -F.col("ord")))
    out = {
        "ord": F.min("ord"), "label": F.min_by("label", "ord"), "summary": longest, "properties": earliest_wins(in_order("properties")),
        "aliases": F.array_distinct(F.flatten(in_order("aliases"))), "refs": F.flatten(in_order("refs")), "n": F.count(F.lit(1)),
    }
    return aggregated(entities.groupBy("source", "type", F.lower("label").alias("key")), out)


def aggregated(groups: GroupedData, out: dict[str, Column]) -> DataFrame:
    """groups.agg() under names that may be those of its input."""
    return groups.agg(*[c.alias(f"_{k}") for k, c in out.items()]).withColumnsRenamed({f"_{k}": k for k in out})


def merge_relationships(relationships: DataFrame) -> DataFrame:
    """One row for each source, type and pair of labels (case folded); earlier properties win."""
    out = {
        "ord": F.min("ord"), "source_label": F.min_by("source_label", "ord"), "target_label": F.min_by("target_label", "ord"), "properties": earliest_wins(in_order("properties")),
        "refs": F.flatten(in_order("refs")), "n": F.count(F.lit(1)),
    }
    return aggregated(relationships.groupBy("source", "type", F.lower("source_label").alias("source_key"), F.lower("target_label").alias("target_key")), out)


def known_names(entities: DataFrame) -> DataFrame:
    """source and name: all labels and aliases, lower-cased, each once."""
    return entities.select("source", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("label"))).alias("name")).select("source", F.lower("name").alias("name")).distinct()


def orphan_relationships(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships with an end that no entity of their source is named by: missing_source and missing_target."""
    names = known_names(entities)
    out = relationships
    for side in ("source", "target"):
        known = names.select("source", F.col("name").alias(f"_{side}"), F.lit(False).alias(f"missing_{side}"))
        out = out.withColumn(f"_{side}", F.lower(f"{side}_label")).join(known, ["source", f"_{side}"], "left").withColumn(f"missing_{side}", F.coalesce(f"missing_{side}", F.lit(True))).drop(f"_{side}")
    return out.where("missing_source or missing_target")


def orphan_rate(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """source, orphans, total, share in percent and rating (2 and 5 percent)."""
    bad = orphan_relationships(entities, relationships).groupBy("source").agg(F.count(F.lit(1)).alias("orphans"))
    both = relationships.groupBy("source").agg(F.count(F.lit(1)).alias("total")).join(bad, "source", "left")
    n = F.coalesce("orphans", F.lit(0)).cast("long")
    share = percent(n, F.col("total"))
    return both.select("source", n.alias("orphans"), "total", share.alias("share"), rated(share, 2.0, 5.0, False).alias("rating"))


def property_coverage(entities: DataFrame) -> DataFrame:
    """source, bare (entities without properties), total, share in percent and rating (95 and 90 percent covered)."""
    bare = F.sum((F.size(F.map_keys("properties")) == 0).cast("long"))
    per = entities.groupBy("source").agg(F.coalesce(bare, F.lit(0)).alias("bare"), F.count(F.lit(1)).alias("total"))
    share = percent(F.col("bare"), F.col("total"))
    return per.select("source", "bare", "total", share.alias("share"), rated(100 - share, 95.0, 90.0).alias("rating"))


def duplicate_labels(entities: DataFrame, key: Column | None = None) -> DataFrame:
    """source, type, key and n of labels that differ in case, accents and spacing only."""
    k = label_key(F.col("label")) if key is None else key
    return entities.groupBy("source", F.lower("type").alias("type"), k.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def token_subsets(entities: DataFrame) -> DataFrame:
    """Pairs of labels of one source and type where one's words are a proper subset of the other's.

    Candidates share the subset's first word in a global order of rarity, so only labels that hold a label's rarest
    word meet."""
    words = F.array_distinct(F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    rows = entities.select("source", "type", "label").distinct().withColumn("words", words).where(F.size("words") > 0)
    each = rows.withColumn("word", F.explode("words"))
    rarity = each.groupBy("source", "type", "word").agg(F.count(F.lit(1)).alias("df"))
    marked = each.join(rarity, ["source", "type", "word"])
    rarest = marked.groupBy("source", "type", "label", "words").agg(F.min(F.struct("df", "word")).alias("r")).select("source", "type", F.col("label").alias("sub"), F.col("words").alias("sub_words"), F.col("r.word").alias("word"))
    pairs = rarest.join(each.select("source", "type", "word", F.col("label").alias("sup"), F.col("words").alias("sup_words")), ["source", "type", "word"])
    inside = (F.size("sub_words") < F.size("sup_words")) & (F.size(F.array_except("sub_words", "sup_words")) == 0)
    return pairs.where(inside).select("source", "type", "sub", "sup")


def label_problems(entities: DataFrame) -> DataFrame:
    """source, type, label and reason of labels that are too short, hold JSON remains, or are numbers."""
    l = F.col("label")  # noqa: E741
    reason = F.when(F.length(l) <= 2, "too-short").when(l.rlike(r'[\[\]{}"\\]'), "json-artifact").when(l.rlike(r"^\d+$"), "numeric-only")
    return entities.select("source", "type", "label", reason.alias("reason")).where("reason is not null")


def truncation(rows: DataFrame) -> DataFrame:
    """source, truncated_chunks, total_chunks, unsalvageable_chunks with share in percent and rating."""
    share = percent(F.col("truncated_chunks"), F.col("total_chunks"))
    rating = F.when((share <= 0) & (F.col("unsalvageable_chunks") == 0), "good").when((share <= 10) & (F.col("unsalvageable_chunks") == 0), "acceptable").otherwise("needs-work")
    return rows.select("source", "truncated_chunks", "total_chunks", "unsalvageable_chunks", share.alias("share"), rating.alias("rating"))


def enum_checklist(entities: DataFrame, controlled: DataFrame, least: int = 4, dominance: float = 0.8, coverage: float = 0.6, key: Column | None = None) -> DataFrame:
    """Types whose labels look copied from their list of allowed values (controlled: type, value)."""
    k = label_key(F.col("label")) if key is None else key
    labels = entities.select("type", k.alias("key")).where("key <> ''").distinct()
    values = controlled.select("type", F.lower(F.trim("value")).alias("key")).where("key <> ''").distinct()
    n_values = values.groupBy("type").agg(F.count(F.lit(1)).alias("values"))
    per = labels.join(values.withColumn("hit", F.lit(1)), ["type", "key"], "left").groupBy("type").agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("matched"))
    both = per.join(size_checked(n_values), "type").where((F.col("values") >= least) & (F.col("matched") > 0))
    both = both.withColumn("dominance", F.col("matched") / F.col("labels")).withColumn("coverage", F.col("matched") / F.col("values")).where((F.col("dominance") >= dominance) & (F.col("coverage") >= coverage))
    return both.select("type", "labels", "values", "matched", F.round("dominance", 2).alias("dominance"), F.round("coverage", 2).alias("coverage"))


def shared_citations(relationships: DataFrame, least: int = 10, span: int = 5) -> DataFrame:
    """source, line_start, line_end and n of narrow citations that many relationships share."""
    cited = relationships.where(F.size("refs") > 0).select("source", F.array_min(F.transform("refs", lambda r: r["start"])).alias("line_start"), F.array_max(F.transform("refs", lambda r: r["end"])).alias("line_end"))
    return cited.where(F.col("line_end") - F.col("line_start") <= span).groupBy("source", "line_start", "line_end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def bare_endpoints(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities without properties that a relationship of their source names."""
    ends = relationships.select("source", F.explode(F.array("source_label", "target_label")).alias("name")).select("source", F.lower("name").alias("name")).distinct()
    bare = entities.where(F.size(F.map_keys("properties")) == 0)
    named = bare.withColumn("name", F.explode(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("label")), F.lower)))
    return named.join(ends, ["source", "name"], "left_semi").select("source", "type", "label", "ord").distinct()


# --- first tier: rules ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Range:
    type: str
    property: str
    kind: str = "number"  # number, integer, percentage or string
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()


def as_number(v: Column) -> Column:
    """A value as a number: texts lose commas and what follows their leading number."""
    lead = F.regexp_extract(F.regexp_replace(v["s"], ",", ""), r"^\s*(-?[\d.]+)", 1)
    return F.coalesce(v["d"], lead.try_cast("double"))


def range_issues(entities: DataFrame, rules: list[Range]) -> DataFrame:
    """source, type, label, property and code of values that break a rule; missing values break none."""
    issues = F.array().cast("array<struct<property:string,code:string>>")
    for r in rules:
        v = F.col("properties")[r.property]
        n, text = as_number(v), plain(v)
        bad = F.lit(None).cast("string")
        if r.values:
            bad = F.when(~text.isin(*r.values), "enum").otherwise(bad)
        if r.pattern:
            bad = F.when(~text.rlike(r.pattern), "pattern").otherwise(bad)
        if r.kind != "string":
            if r.high is not None:
                bad = F.when(n > r.high, "above").otherwise(bad)
            if r.low is not None:
                bad = F.when(n < r.low, "below").otherwise(bad)
            if r.kind == "integer":
                bad = F.when(n != F.floor(n), "not-integer").otherwise(bad)
            if r.kind == "percentage" and r.low is None and r.high is None:
                bad = F.when((n < 0) | (n > 100), "percentage").otherwise(bad)
            bad = F.when(n.isNull(), "not-numeric").otherwise(bad)
        held = (F.col("type") == r.type) & text.isNotNull() & bad.isNotNull()
        one = F.array(F.struct(F.lit(r.property).alias("property"), bad.alias("code")))
        issues = F.concat(issues, F.when(held, one).otherwise(F.array().cast("array<struct<property:string,code:string>>")))
    return entities.select("source", "type", "label", F.explode(issues).alias("i")).select("source", "type", "label", "i.property", "i.code")


def schema_issues(entities: DataFrame, relationships: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """source, code and subject: unknown types (only with a vocabulary), blank labels, missing ends."""
    e_types, r_types = [t.type for t in vocabulary.entity_types], [t.type for t in vocabulary.relationship_types]
    out = entities.where(F.trim("label") == "").select("source", F.lit("blank-label").alias("code"), F.col("type").alias("subject"))
    if e_types:
        out = out.unionByName(entities.where(~F.col("type").isin(*e_types)).select("source", F.lit("unknown-entity-type").alias("code"), F.col("type").alias("subject")))
    if r_types:
        out = out.unionByName(relationships.where(~F.col("type").isin(*r_types)).select("source", F.lit("unknown-relationship-type").alias("code"), F.col("type").alias("subject")))
    lost = orphan_relationships(entities, relationships).select("source", F.lit("missing-end").alias("code"), F.when(F.col("missing_source"), F.col("source_label")).otherwise(F.col("target_label")).alias("subject"))
    return out.unionByName(lost)


def structure_issues(entities: DataFrame, relationships: DataFrame, required: dict[str, str] | None = None, most_entities: int | None = None, most_relationships: int | None = None, no_orphans: bool = True) -> DataFrame:
    """source, code and subject: rows without or with inverted refs, repeated labels, too many rows, lonely
    entities, entities without the relationship their type requires ({entity type: relationship type})."""
    pick = lambda f, code, subject: f.select("source", F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    out = pick(entities.where(F.size("refs") < 1), "no-refs", F.col("label"))
    out = out.unionByName(pick(entities.where(F.exists("refs", lambda r: (r["start"] < 1) | (r["end"] < r["start"]))), "bad-refs", F.col("label")))
    repeated = entities.groupBy("source", F.lower(F.concat_ws(":", "type", "label")).alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(repeated.select("source", F.lit("duplicate").alias("code"), "subject"))
    for frame, most, code in ((entities, most_entities, "too-many-entities"), (relationships, most_relationships, "too-many-relationships")):
        if most is not None:
            per = frame.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
            out = out.unionByName(pick(per, code, F.col("n")))
    ends = relationships.select("source", "type", F.explode(F.array(F.lower("source_label"), F.lower("target_label"))).alias("name"))
    if no_orphans:
        lonely = entities.withColumn("name", F.lower("label")).join(ends.select("source", "name").distinct(), ["source", "name"], "left_anti")
        out = out.unionByName(pick(lonely, "lonely", F.col("label")))
    for etype, rtype in (required or {}).items():
        has = relationships.where(F.col("type") == rtype).select("source", F.lower("source_label").alias("name")).distinct()
        lacking = entities.where(F.col("type") == etype).withColumn("name", F.lower("label")).join(has, ["source", "name"], "left_anti")
        out = out.unionByName(pick(lacking, f"requires-{rtype}", F.col("label")))
    return out


# Codes that fail a document rather than warn.
ERRORS = ("blank-label", "unknown-entity-type", "unknown-relationship-type", "missing-end", "bad-refs", "not-numeric")


def verdicts(sources: DataFrame, issues: DataFrame) -> DataFrame:
    """source and verdict: fail with an error, warnings with another issue, else pass."""
    per = issues.groupBy("source").agg(F.max(F.col("code").isin(*ERRORS).cast("int")).alias("worst"))
    return sources.select("source").distinct().join(per, "source", "left").select("source", F.when(F.col("worst") == 1, "fail").when(F.col("worst") == 0, "warnings").otherwise("pass").alias("verdict"))


# --- conformance ----------------------------------------------------------------------------------------------------


def conformance(entities: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """source, type, label, class and field of each departure from the vocabulary."""
    named = F.when(F.col("e.code") == "unknown_type", "unknown-type").when(F.col("e.code") == "required", "required-property-missing").when(F.col("e.code") == "enum", "closed-enum-value").when(F.col("e.code").isin("source_type", "target_type"), "endpoint-type").otherwise("other")
    return entities.withColumn("e", F.explode(entity_errors(vocabulary))).select("source", "type", "label", named.alias("class"), F.col("e.field").alias("field"))


def class_counts(found: DataFrame, examples: int = 5) -> DataFrame:
    """class, n and the first labels by order."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy("label", "source"))
    some = found.withColumn("r", rank).where(F.col("r") <= examples).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("x"))
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(some, "class").select("class", "n", F.array_join(F.transform("x", lambda x: x["label"]), "|").alias("examples"))


def enum_offenders(entities: DataFrame, vocabulary: Vocabulary, least: int = 2) -> DataFrame:
    """type, property, value and n of texts outside a closed list, for those seen at least `least` times."""
    rows = [(t.type, p.name, list(p.values)) for t in vocabulary.entity_types for p in t.properties if p.values]
    closed = entities.sparkSession.createDataFrame(rows, "type string, property string, allowed array<string>")
    seen = entities.select("type", F.explode("properties").alias("property", "v")).select("type", "property", F.col("v.s").alias("value")).where("value is not null")
    per = seen.groupBy("type", "property", "value").agg(F.count(F.lit(1)).alias("n")).join(size_checked(closed), ["type", "property"])
    return per.where(~F.array_contains("allowed", F.col("value")) & (F.col("n") >= least)).drop("allowed")


# --- merges ---------------------------------------------------------------------------------------------------------


def merge_confidence(log: DataFrame, high: float = 0.95, medium: float = 0.9) -> DataFrame:
    """high, medium, low (numbers of merges) and rating."""
    c = F.col("confidence")
    count = lambda held: F.coalesce(F.sum(held.cast("long")), F.lit(0)).cast("long")
    per = log.agg(count(c >= high).alias("high"), count((c < high) & (c >= medium)).alias("medium"), count(c < medium).alias("low"))
    return per.withColumn("rating", F.when((F.col("low") == 0) & (F.col("medium") == 0), "good").when(F.col("low") == 0, "acceptable").otherwise("needs-work"))


def alias_specificity(registry: DataFrame, short: int = 4) -> DataFrame:
    """type, label, alias and reason of aliases that are short or used by more than one type."""
    each = registry.select("type", "label", F.explode("aliases").alias("alias")).withColumn("key", F.lower("alias"))
    types = each.groupBy("key").agg(F.countDistinct("type").alias("types"))
    reason = F.when(F.length("alias") <= short, "too-short").when(F.col("types") > 1, "ambiguous-across-types")
    return each.join(types, "key").select("type", "label", "alias", reason.alias("reason")).where("reason is not null")


def cross_source(registry: DataFrame) -> DataFrame:
    """type, label and sources of entries with two source documents or more."""
    return registry.select("type", "label", F.size("source_documents").alias("sources")).where("sources >= 2")


def type_consistency(log: DataFrame, least: float = 0.3) -> DataFrame:
    """Merges whose sides share too few property keys; a side without keys is not judged."""
    both = log.where((F.size("canonical_property_keys") > 0) & (F.size("merged_property_keys") > 0))
    overlap = key_jaccard(F.col("canonical_property_keys"), F.col("merged_property_keys"))
    return both.withColumn("overlap", F.round(overlap, 2)).where(overlap < least).select("entity_type", "canonical_label", "merged_label", "overlap")


def merge_rates(registry: DataFrame, log: DataFrame) -> DataFrame:
    """type, entries, merged and rate = merged / (entries + merged)."""
    entries = registry.groupBy("type").agg(F.count(F.lit(1)).alias("entries"))
    merged = log.groupBy(F.col("entity_type").alias("type")).agg(F.count(F.lit(1)).alias("merged"))
    both = entries.join(merged, "type", "full_outer").na.fill(0, ["entries", "merged"])
    return both.withColumn("rate", F.round(F.col("merged") / (F.col("entries") + F.col("merged")), 4))


def verdict_rates(items: DataFrame) -> DataFrame:
    """source, type, counts of each verdict and accuracy = (confirmed + corrected) / all."""
    # Verdicts from best to worst.
    names = ["confirmed", "unverifiable", "corrected", "mismatch", "hallucinated"]
    per = items.groupBy("source", "type").pivot("verdict", names).agg(F.count(F.lit(1))).na.fill(0, names)
    total = sum((F.col(n) for n in names), F.lit(0))
    worst = F.lit("confirmed")
    for n in names[1:]:
        worst = F.when(F.col(n) > 0, n).otherwise(worst)
    return per.withColumn("accuracy", F.round((F.col("confirmed") + F.col("corrected")) / total, 4)).withColumn("overall", worst)


def checkpoint(tier1: DataFrame, accuracy: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """One row with the verdict over all documents: fail if a document failed or the mean accuracy (source, accuracy)
    of the checked ones is too low, warnings if one has them, else pass; and the numbers behind it."""
    n = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0)).alias(v)
    out = tier1.agg(F.count(F.lit(1)).alias("documents"), n("fail"), n("warnings"))
    mean = F.lit(None).cast("double")
    if accuracy is not None:
        out = out.crossJoin(accuracy.agg(F.avg("accuracy").alias("accuracy")))
        mean = F.col("accuracy")
    low = F.coalesce(mean < least, F.lit(False))
    verdict = F.when((F.col("fail") > 0) | low, "fail").when(F.col("warnings") > 0, "warnings").otherwise("pass")
    return out.select("documents", "fail", "warnings", mean.alias("accuracy"), verdict.alias("verdict"))
