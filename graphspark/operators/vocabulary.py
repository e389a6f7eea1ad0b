"""Vocabulary: validation of rows, audits, differences, governance, migration and inference."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.names import is_identifier, screaming_snake
from graphspark.functions.props import is_null
from graphspark.functions.similarity import jaro_winkler_of
from graphspark.model import EntityType, Graph, Property, RelationshipType, Vocabulary

_ERROR = "array<struct<code:string,field:string>>"


def _error(code: str, field: str | Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field"))


def _when(held: Column, code: str, field: str | Column) -> Column:
    return F.when(F.coalesce(held, F.lit(False)), F.array(_error(code, field))).otherwise(F.array().cast(_ERROR))


def property_errors(props: Column, declared: Iterable[Property]) -> Column:
    """Errors of a bag against declared properties: missing required ones, wrong types, values outside an
    enumeration, unknown keys. A type without declared properties accepts anything."""
    declared = tuple(declared)
    if not declared:
        return F.array().cast(_ERROR)
    parts = []
    for p in declared:
        v = props[p.name]
        if p.required:
            parts.append(_when(is_null(v), "required", p.name))
        part = {"number": "d", "boolean": "b"}.get(p.type, "s")
        parts.append(_when(~is_null(v) & v[part].isNull(), "type", p.name))
        if p.type == "date":
            parts.append(_when(v["s"].isNotNull() & F.try_to_timestamp(v["s"]).isNull(), "date", p.name))
        if p.type == "enum" and p.values:
            parts.append(_when(v["s"].isNotNull() & ~v["s"].isin(*p.values), "enum", p.name))
    unknown = F.array_sort(F.array_except(F.map_keys(props), F.array(*[F.lit(p.name) for p in declared])))
    parts.append(F.coalesce(F.transform(unknown, lambda k: _error("unknown_property", k)), F.array().cast(_ERROR)))
    return F.concat(*parts)


def _by_type(type_: Column, cases: dict[str, Column], other: Column) -> Column:
    return reduce(lambda rest, kv: F.when(type_ == kv[0], kv[1]).otherwise(rest), cases.items(), other)


def entity_errors(vocabulary: Vocabulary) -> Column:
    """Errors of a vertex row; an unknown type, then a blank label, hide the rest."""
    props = {t.type: property_errors(F.col("properties"), t.properties) for t in vocabulary.entity_types}
    of_props = _by_type(F.col("type"), props, F.array().cast(_ERROR))
    known = F.col("type").isin(*props) if props else F.lit(False)
    blank = F.trim(F.coalesce("label", F.lit(""))) == ""
    return F.when(~F.coalesce(known, F.lit(False)), F.array(_error("unknown_type", F.col("type")))).when(blank, F.array(_error("label", "label"))).otherwise(of_props)


def patch_errors(patch: Column, entity_type: EntityType) -> Column:
    """Errors of an update's bag: nulls delete and are fine; nothing is missing from a patch."""
    given = F.map_filter(patch, lambda _, v: ~is_null(v))
    return property_errors(given, [replace(p, required=False) for p in entity_type.properties])


def relationship_errors(vocabulary: Vocabulary) -> Column:
    """Errors of an edge row that has source_type and target_type columns. Types are compared in their upper-case
    form; an empty list of allowed ends means any."""
    type_ = screaming_snake(F.col("type"))
    cases = {}
    for t in vocabulary.relationship_types:
        parts = [property_errors(F.col("properties"), t.properties)]
        if t.sources:
            parts.insert(0, _when(~F.col("source_type").isin(*t.sources), "source_type", F.col("source_type")))
        if t.targets:
            parts.insert(-1, _when(~F.col("target_type").isin(*t.targets), "target_type", F.col("target_type")))
        cases[t.type] = F.concat(*parts)
    known = type_.isin(*cases) if cases else F.lit(False)
    return F.when(~F.coalesce(known, F.lit(False)), F.array(_error("unknown_type", F.col("type")))).otherwise(_by_type(type_, cases, F.array().cast(_ERROR)))


def audit_entities(graph: Graph, vocabulary: Vocabulary) -> DataFrame:
    """id, code and field of each problem of the vertices."""
    found = graph.vertices.select("id", F.explode(entity_errors(vocabulary)).alias("e"))
    return found.select("id", "e.code", "e.field")


def audit_relationships(graph: Graph, vocabulary: Vocabulary) -> DataFrame:
    """id, code and field of each problem of the edges: missing ends, self-references, and, if both ends exist, what
    the vocabulary forbids."""
    end = lambda s: graph.vertices.select(F.col("id").alias(f"{s}_id"), F.col("type").alias(f"{s}_type"))
    both = graph.edges.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    there = F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    errors = F.concat(
        _when(F.col("source_type").isNull(), "missing_source", F.col("source_id")),
        _when(F.col("target_type").isNull(), "missing_target", F.col("target_id")),
        _when(F.col("source_id") == F.col("target_id"), "self_reference", F.col("source_id")),
        F.when(there, relationship_errors(vocabulary)).otherwise(F.array().cast(_ERROR)),
    )
    return both.select("id", F.explode(errors).alias("e")).select("id", "e.code", "e.field")


def audit_page(issues: DataFrame, offset: int = 0, take: int = 200) -> tuple[DataFrame, bool]:
    """A page of issues in order, and whether it is the last."""
    order = issues.orderBy("id", "code", "field")
    return order.offset(offset).limit(take), issues.count() <= offset + take


# --- the vocabulary itself: small objects on the driver ------------------------------------------------------------


def property_problems(p: Property) -> list[str]:
    out = [] if is_identifier(p.name) else [f"name {p.name}"]
    if p.type not in ("string", "number", "boolean", "date", "enum"):
        out.append(f"type {p.type}")
    if p.embeddable and p.type != "string":
        out.append(f"{p.name}: only texts can be embedded")
    return out


def bumped(version: str, part: str) -> str:
    major, minor, _ = (int(x) for x in version.split("."))
    return f"{major + 1}.0.0" if part == "major" else f"{major}.{minor + 1}.0"


def latest(a: str, b: str) -> str:
    return max(a, b, key=lambda v: tuple(int(x) for x in v.split(".")))


def _normal(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"[-\s.]+", "_", name.strip().lower()))


def similar_types(name: str, existing: Iterable[str], threshold: float = 0.85) -> list[tuple[str, float]]:
    """Existing types like a new name: equal in normal form (1.0) or similar by Jaro-Winkler; best first."""
    scored = [(t, 1.0 if _normal(t) == _normal(name) else jaro_winkler_of(_normal(t), _normal(name))) for t in existing]
    return sorted([x for x in scored if x[1] >= threshold], key=lambda x: (-x[1], x[0]))


def closest_type(name: str, existing: Iterable[str]) -> str | None:
    """The first type whose name holds the given one, or is held by it."""
    low = name.lower()
    return next((t for t in existing if low in t.lower() or t.lower() in low), None)


@dataclass(frozen=True)
class Governance:
    mode: str = "open"  # open, managed or locked
    require_approval: bool = False
    deduplicate: bool = True
    threshold: float = 0.85


@dataclass(frozen=True)
class Proposal:
    kind: str  # add, edit or delete
    entity: EntityType | None = None
    relationship: RelationshipType | None = None
    name: str = ""  # of the type to delete


@dataclass(frozen=True)
class Decision:
    status: str  # applied, pending or rejected
    vocabulary: Vocabulary
    reason: str = ""


def decide(vocabulary: Vocabulary, proposal: Proposal, governance: Governance) -> Decision:
    """A locked vocabulary rejects; an addition like an existing type is rejected; a managed one that requires
    approval holds it; else it is applied."""
    if governance.mode == "locked":
        return Decision("rejected", vocabulary, "locked")
    new = proposal.entity or proposal.relationship
    if new is not None and not is_identifier(new.type):
        return Decision("rejected", vocabulary, f"name {new.type}")
    bad = [x for p in (new.properties if new else ()) for x in property_problems(p)]
    if bad:
        return Decision("rejected", vocabulary, "; ".join(bad))
    if proposal.kind == "add" and governance.deduplicate:
        peers = vocabulary.entity_types if proposal.entity else vocabulary.relationship_types
        like = similar_types(new.type, [t.type for t in peers], governance.threshold)
        if like:
            return Decision("rejected", vocabulary, f"like {like[0][0]}")
    if governance.mode == "managed" and governance.require_approval:
        return Decision("pending", vocabulary)
    return Decision("applied", apply(vocabulary, proposal))


def apply(vocabulary: Vocabulary, proposal: Proposal) -> Vocabulary:
    """Additions and edits raise the minor version, deletions the major one."""
    if proposal.kind == "delete":
        out = replace(vocabulary, entity_types=tuple(t for t in vocabulary.entity_types if t.type != proposal.name), relationship_types=tuple(t for t in vocabulary.relationship_types if t.type != proposal.name))
        return replace(out, version=bumped(vocabulary.version, "major"))
    out = vocabulary.with_entity(proposal.entity) if proposal.entity else vocabulary.with_relationship(proposal.relationship)
    return replace(out, version=bumped(vocabulary.version, "minor"))


def merged_properties(old: tuple[Property, ...], remove: Iterable[str] = (), update: Iterable[Property] = (), add: Iterable[Property] = ()) -> tuple[Property, ...]:
    """Removals, then changes, then additions; adding a name that exists changes nothing."""
    gone, changed = set(remove), {p.name: p for p in update}
    kept = [changed.get(p.name, p) for p in old if p.name not in gone]
    have = {p.name for p in kept}
    return (*kept, *(p for p in add if p.name not in have))


def without_type(graph: Graph, name: str) -> Graph:
    """The graph after a type is deleted: its vertices with their edges, or its edges, are gone."""
    from graphspark.operators.mutate import delete_vertices

    left = delete_vertices(graph, graph.vertices.where(F.col("type") == name).select("id"))
    return Graph(left.vertices, left.edges.where(F.col("type") != name))


def migrate(source: Vocabulary, target: Vocabulary, mode: str = "extend") -> Vocabulary:
    """The target's vocabulary after an import: "reject" refuses unknown types, "extend" adds them and new
    properties; where both differ the target wins."""
    lost = [t.type for t in source.entity_types if not target.entity(t.type)] + [t.type for t in source.relationship_types if not target.relationship(t.type)]
    if mode == "reject" and lost:
        raise ValueError(f"unknown types: {', '.join(lost)}")
    out = target
    for t in source.entity_types:
        mine = target.entity(t.type)
        out = out.with_entity(replace(mine, properties=merged_properties(mine.properties, add=t.properties)) if mine else t)
    for t in source.relationship_types:
        mine = target.relationship(t.type)
        out = out.with_relationship(replace(mine, properties=merged_properties(mine.properties, add=t.properties)) if mine else t)
    return out if out == target else replace(out, version=latest(source.version, bumped(target.version, "minor")))


def diff(old: DataFrame, new: DataFrame, key: str = "type") -> DataFrame:
    """key and change (added, removed or modified) of two tables of type definitions with equal columns."""
    a = old.select(F.col(key), F.to_json(F.struct(*sorted(old.columns))).alias("_old"))
    b = new.select(F.col(key), F.to_json(F.struct(*sorted(new.columns))).alias("_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def infer_properties(rows: DataFrame, key: str = "type") -> DataFrame:
    """type, name, kind (string, number, boolean or mixed) and n of the properties seen in each type of rows."""
    seen = rows.select(F.col(key).alias("type"), F.explode("properties").alias("name", "v"))
    kind = F.when(F.col("v.d").isNotNull(), "number").when(F.col("v.b").isNotNull(), "boolean").when(F.col("v.s").isNotNull(), "string")
    per = seen.groupBy("type", "name", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = F.collect_set("kind")
    return per.groupBy("type", "name").agg(F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(F.size(kinds) > 1, "mixed").alias("kind"), F.sum("n").alias("n"))
