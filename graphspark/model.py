"""The property graph: tables of vertices and edges, their schemas, and the vocabulary that governs them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

#: A property value by type; an explicit null has no part set, a missing key has no value at all.
VALUE = "struct<s:string,d:double,b:boolean,j:string>"
BAG = f"map<string,{VALUE}>"
PROVENANCE = "struct<created_by:string,created_by_type:string,created_at:string,created_in_conversation:string,created_from_message:string,modified_by:string,modified_by_type:string,modified_at:string,modified_in_conversation:string,modified_from_message:string>"
VERTEX = f"id string, slug string, type string, label string, summary string, properties {BAG}, data string, data_format string, provenance {PROVENANCE}, embedding array<float>"
EDGE = f"id string, type string, source_id string, target_id string, properties {BAG}, bidirectional boolean, provenance {PROVENANCE}"

#: Columns of a vertex by level of detail; the embedding is never among them.
DETAIL = {
    "brief": ("id", "slug", "type", "label", "summary"),
    "summary": ("id", "slug", "type", "label", "summary", "properties"),
    "full": ("id", "slug", "type", "label", "summary", "properties", "data", "data_format", "provenance"),
}


@dataclass(frozen=True)
class Graph:
    """One repository's vertices and edges. Frames may lack optional columns. `complete` states that both ends of
    every edge exist, so walks need not look them up."""

    vertices: DataFrame
    edges: DataFrame
    complete: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "string"  # string, number, boolean, date or enum
    required: bool = False
    description: str = ""
    values: tuple[str, ...] = ()
    embeddable: bool = False


@dataclass(frozen=True)
class EntityType:
    type: str
    description: str = ""
    properties: tuple[Property, ...] = ()
    version: str = "1.0.0"


@dataclass(frozen=True)
class RelationshipType:
    type: str
    description: str = ""
    sources: tuple[str, ...] = ()  # empty: any
    targets: tuple[str, ...] = ()
    bidirectional: bool = False
    properties: tuple[Property, ...] = ()
    version: str = "1.0.0"


@dataclass(frozen=True)
class Vocabulary:
    entity_types: tuple[EntityType, ...] = ()
    relationship_types: tuple[RelationshipType, ...] = ()
    version: str = "0.0.0"

    def entity(self, name: str) -> EntityType | None:
        return next((t for t in self.entity_types if t.type == name), None)

    def relationship(self, name: str) -> RelationshipType | None:
        return next((t for t in self.relationship_types if t.type == name), None)

    def with_entity(self, new: EntityType) -> Vocabulary:
        return replace(self, entity_types=(*(t for t in self.entity_types if t.type != new.type), new))

    def with_relationship(self, new: RelationshipType) -> Vocabulary:
        return replace(self, relationship_types=(*(t for t in self.relationship_types if t.type != new.type), new))


@dataclass(frozen=True)
class Page:
    """One page of ordered rows; total and has_more are computed on demand."""

    rows: DataFrame
    everything: DataFrame
    limit: int
    offset: int
    _count: list[int] = field(default_factory=list, compare=False)

    @property
    def total(self) -> int:
        if not self._count:
            self._count.append(self.everything.count())
        return self._count[0]

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total
