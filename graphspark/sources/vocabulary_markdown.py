"""Vocabularies written as Markdown: a heading for each entity type, tables of properties and relationships."""

from __future__ import annotations

import re
from dataclasses import replace

from graphspark.model import EntityType, Property, RelationshipType, Vocabulary
from graphspark.operators.text import markdown_tables

_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_TICKED = re.compile(r"`([^`]+)`")
# Type words in a table and the property types they mean.
_TYPES = {"string": "string", "text": "string", "number": "number", "integer": "number", "float": "number", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "date", "enum": "enum"}


def _bare(cell: str) -> str:
    m = _TICKED.search(cell)
    return (m[1] if m else re.sub(r"[*_]{2}", "", cell)).strip()


def _yes(cell: str) -> bool:
    return cell.strip().lower() in ("yes", "true", "y", "required", "✓")


def _columns(head: list[str]) -> dict[str, int]:
    return {re.sub(r"\s+", " ", h.lower()): i for i, h in enumerate(head)}


def _property(head: dict[str, int], row: list[str]) -> Property:
    cell = lambda name: row[head[name]] if name in head and head[name] < len(row) else ""
    said = _bare(cell("type")).lower()
    kind = _TYPES.get(re.split(r"[^a-z]", said)[0] if said else "string", "string")
    about = cell("description")
    return Property(_bare(cell("property")), kind, _yes(cell("required")), about, tuple(_TICKED.findall(about)) if kind == "enum" else ())


def _ends(cell: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    parts = re.split(r"\s*(?:→|->)\s*", cell)
    if len(parts) != 2:
        return (), ()
    names = lambda s: tuple(x for x in (re.sub(r"[`*\s]", "", y) for y in re.split(r"[,/|]| or ", s)) if x and x.lower() != "any")
    return names(parts[0]), names(parts[1])


def sections(text: str) -> list[tuple[int, str, str]]:
    """(level, heading, text below it) of each heading, code fences aside."""
    out: list[tuple[int, str, list[str]]] = []
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.strip().startswith("```")
        m = None if fenced else _HEADING.match(line)
        if m:
            out.append((len(m[1]), m[2], []))
        elif out:
            out[-1][2].append(line)
    return [(lv, h, "\n".join(body)) for lv, h, body in out]


def parse(text: str) -> Vocabulary:
    """The vocabulary of a Markdown document."""
    part, entities, relations, extra = "", [], {}, {}
    for level, heading, body in sections(text):
        low = heading.lower()
        if level <= 2:
            part = "entity" if "entity types" in low else "relationship" if "relationship types" in low else ""
            continue
        tables = [(_columns(rows[0]), rows[1:]) for _, rows in markdown_tables(body)]
        if part == "entity" and level == 3:
            props = [_property(h, r) for h, rows in tables if "property" in h for r in rows]
            about = next((x.strip() for x in body.split("\n\n") if x.strip() and not x.strip().startswith("|")), "")
            entities.append(EntityType(_bare(heading), about, tuple(props)))
        elif part == "relationship":
            named = _TICKED.search(heading)
            if named and "propert" in low:
                extra[named[1]] = tuple(_property(h, r) for h, rows in tables if "property" in h for r in rows)
            for h, rows in tables:
                ends = next((k for k in h if "→" in k or "->" in k), None)
                if "type" in h and ends:
                    for r in rows:
                        a, b = _ends(r[h[ends]])
                        two = "bidirectional" in h and h["bidirectional"] < len(r) and _yes(r[h["bidirectional"]])
                        relations[_bare(r[h["type"]])] = RelationshipType(_bare(r[h["type"]]), r[h["description"]] if "description" in h else "", a, b, two)
    return Vocabulary(tuple(entities), tuple(replace(t, properties=extra.get(n, ())) for n, t in relations.items()), "1.0.0")


def controlled_values(text: str) -> dict[str, list[str]]:
    """Values listed for each entity type in tables headed "Allowed ..." or "Recommended ..."."""
    out: dict[str, list[str]] = {}
    current = ""
    for level, heading, body in sections(text):
        if level == 3:
            current = _bare(heading)
        for _, rows in markdown_tables(body):
            if re.match(r"(allowed|recommended)", rows[0][0].lower()):
                out.setdefault(current, []).extend(_bare(r[0]) for r in rows[1:] if r[0])
    return out
