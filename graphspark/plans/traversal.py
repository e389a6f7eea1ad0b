"""Traversal specifications: what to start from, which steps to walk, and what to return."""

from __future__ import annotations

import re
from dataclasses import dataclass

from graphspark.functions.props import Filter

DIRECTIONS, MODES, PROJECTIONS = ("out", "in", "both"), ("terminal", "path", "all"), ("values", "distinct", "count")
STEPS_MOST, DEPTH_MOST, LIMIT_MOST, LIMIT_DEFAULT, OFFSET_MOST = 6, 10, 200, 50, 1000
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
# Keys of the system that no projection may name.
RESERVED = frozenset(("id", "label", "type", "slug", "summary", "data", "provenance", "embedding", "repositoryId", "entityType"))


@dataclass(frozen=True)
class Repeat:
    max_depth: int
    until: tuple[Filter, ...] = ()
    until_types: tuple[str, ...] = ()
    emit_intermediates: bool = False


@dataclass(frozen=True)
class Step:
    direction: str = "out"
    relationship_types: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    relationship_filters: tuple[Filter, ...] = ()
    entity_filters: tuple[Filter, ...] = ()
    repeat: Repeat | None = None


@dataclass(frozen=True)
class Projection:
    properties: tuple[str, ...]
    mode: str = "values"


@dataclass(frozen=True)
class Traversal:
    start_id: str | None = None
    start_slug: str | None = None
    start_type: str | None = None
    start_filters: tuple[Filter, ...] = ()
    steps: tuple[Step, ...] = ()
    return_mode: str = "terminal"
    projection: Projection | None = None
    deduplicate: bool = True
    limit: int = LIMIT_DEFAULT
    offset: int = 0
    emit_all: bool = False  # repeated steps return every depth, not only the last


def problems(spec: Traversal) -> list[str]:
    """Everything that is wrong with a specification; none if it can run."""
    out = []
    if not (spec.start_id or spec.start_slug or spec.start_type or spec.start_filters):
        out.append("start: an id, a slug, a type or filters are needed")
    if len(spec.steps) > STEPS_MOST:
        out.append(f"steps: at most {STEPS_MOST}")
    if sum(s.repeat.max_depth if s.repeat else 1 for s in spec.steps) > DEPTH_MOST:
        out.append(f"steps: their depths add up to more than {DEPTH_MOST}")
    if spec.return_mode not in MODES:
        out.append(f"return mode: {spec.return_mode}")
    if not 1 <= spec.limit <= LIMIT_MOST:
        out.append(f"limit: 1 to {LIMIT_MOST}")
    if not 0 <= spec.offset <= OFFSET_MOST:
        out.append(f"offset: 0 to {OFFSET_MOST}")
    for i, s in enumerate(spec.steps):
        if s.direction not in DIRECTIONS:
            out.append(f"step {i}: direction {s.direction}")
        if s.repeat and s.repeat.max_depth < 1:
            out.append(f"step {i}: a repeat needs a depth of 1 at least")
        out += [f"step {i}: name {n}" for n in (*s.relationship_types, *s.entity_types) if not _NAME.match(n)]
        out += [f"step {i}: property {f.key}" for f in (*s.relationship_filters, *s.entity_filters) if not _NAME.match(f.key)]
    if spec.projection:
        if spec.projection.mode not in PROJECTIONS:
            out.append(f"projection: {spec.projection.mode}")
        if not spec.projection.properties:
            out.append("projection: no properties")
        out += [f"projection: name {p}" for p in spec.projection.properties if not _NAME.match(p)]
        out += [f"projection: {p} is reserved" for p in spec.projection.properties if p in RESERVED]
        if spec.return_mode != "terminal":
            out.append("projection: only with the terminal mode")
    return out


def checked(spec: Traversal) -> Traversal:
    found = problems(spec)
    if found:
        raise ValueError("; ".join(found))
    return spec


def fan_out(spec: Traversal, per_hop: int = 10, most: int = 10_000) -> int:
    """Rows that a traversal may touch: ten times more for each hop, bounded."""
    n = 1
    for s in spec.steps:
        n = min(most, n * (per_hop * s.repeat.max_depth if s.repeat else per_hop))
    return n
