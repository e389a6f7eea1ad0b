"""Replay of corrections on extracted rows: deterministic, in order, groups all or nothing."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order of operations within a group.
ORDER = {"create": 0, "retarget": 1, "update": 2, "remove-property": 2, "delete": 3}


@dataclass
class Extraction:
    """entities: label, type, properties, aliases, refs; relationships: type, source, target, properties."""

    entities: list[dict[str, Any]] = field(default_factory=list)
    relationships: list[dict[str, Any]] = field(default_factory=list)


class Refused(Exception):
    """A correction that cannot be applied."""


def _entity(x: Extraction, label: str | None) -> dict[str, Any]:
    hit = next((e for e in x.entities if e["label"].lower() == (label or "").lower()), None)
    if hit is None:
        raise Refused(f"no entity {label}")
    return hit


def _relationship(x: Extraction, key: dict[str, str] | None) -> dict[str, Any]:
    same = lambda r: key and all(r[k].lower() == (key.get(k) or "").lower() for k in ("type", "source", "target"))
    hit = next((r for r in x.relationships if same(r)), None)
    if hit is None:
        raise Refused(f"no relationship {key}")
    return hit


def _update(x: Extraction, c: dict[str, Any]) -> None:
    item = _entity(x, c.get("label")) if c["item"] == "entity" else _relationship(x, c.get("key"))
    name, value = c.get("property"), c.get("value")
    if name in ("label", "type", "summary") and c["item"] == "entity":
        if name == "label":
            for r in x.relationships:
                for end in ("source", "target"):
                    if r[end].lower() == item["label"].lower():
                        r[end] = value
        item[name] = value
    elif name:
        item.setdefault("properties", {})[name] = value
    else:
        raise Refused("no property")


def _remove(x: Extraction, c: dict[str, Any]) -> None:
    item = _entity(x, c.get("label")) if c["item"] == "entity" else _relationship(x, c.get("key"))
    item.setdefault("properties", {}).pop(c.get("property"), None)  # again: nothing to do


def _delete(x: Extraction, c: dict[str, Any]) -> None:
    if c["item"] == "relationship":
        x.relationships.remove(_relationship(x, c.get("key")))
        return
    gone = _entity(x, c.get("label"))
    x.entities.remove(gone)
    low = gone["label"].lower()
    x.relationships = [r for r in x.relationships if low not in (r["source"].lower(), r["target"].lower())]


def _create(x: Extraction, c: dict[str, Any]) -> None:
    new = c.get("value")
    if not isinstance(new, dict):
        raise Refused("nothing to create")
    if c["item"] == "entity":
        if not new.get("refs"):
            raise Refused("a new entity needs refs")
        if any(e["label"].lower() == new["label"].lower() for e in x.entities):
            raise Refused(f"{new['label']} exists")
        x.entities.append(copy.deepcopy(new))
    else:
        for end in ("source", "target"):
            _entity(x, new.get(end))
        x.relationships.append(copy.deepcopy(new))


def _retarget(x: Extraction, c: dict[str, Any]) -> None:
    """Ties one end of a relationship to another entity; if the same relationship exists, the two become one."""
    r, end = _relationship(x, c.get("key")), c.get("endpoint")
    if end not in ("source", "target"):
        raise Refused(f"endpoint {end}")
    new = _entity(x, c.get("new_label"))["label"]
    moved = {**r, end: new}
    same = next((o for o in x.relationships if o is not r and all(o[k].lower() == moved[k].lower() for k in ("type", "source", "target"))), None)
    if same is None:
        r[end] = new
    else:
        same["properties"] = {**r.get("properties", {}), **same.get("properties", {})}
        x.relationships.remove(r)


_HOW: dict[str, Callable[[Extraction, dict[str, Any]], None]] = {"update": _update, "remove-property": _remove, "delete": _delete, "create": _create, "retarget": _retarget}


def replay(x: Extraction, corrections: list[dict[str, Any]]) -> tuple[Extraction, list[tuple[int, str, str]]]:
    """The corrected extraction and (place, status, reason) of each correction: applied, failed, or failed with its
    group. A group is applied at the place of its first member, in the order of ORDER, all or nothing."""
    x, report, seen = copy.deepcopy(x), [], set()
    for at, c in enumerate(corrections):
        group = c.get("group")
        if group in seen:
            continue
        members = [(at, c)] if not group else [(k, o) for k, o in enumerate(corrections) if o.get("group") == group]
        if group:
            seen.add(group)
            members.sort(key=lambda m: (ORDER.get(m[1].get("operation"), 9), m[0]))
        trial = copy.deepcopy(x)
        why = ""
        for k, o in members:
            try:
                if o.get("operation") not in _HOW:
                    raise Refused(f"operation {o.get('operation')}")
                _HOW[o["operation"]](trial, o)
            except Refused as e:
                why = f"{k}: {e}" if group else str(e)
                break
        if not why:
            x = trial
        report += [(k, "failed" if why else "applied", why) for k, _ in members]
    return x, sorted(report)


def apply_corrections(extractions: DataFrame, corrections: DataFrame) -> DataFrame:
    """source, extraction (JSON) and report (JSON) of each extraction (source, extraction) after its corrections
    (source, ord, correction): JSON texts. A source's corrections meet in one task, as they build on each other."""
    per = corrections.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "correction"))), lambda c: c["correction"]).alias("corrections"))
    both = extractions.join(per, "source", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for source, text, todo in zip(pdf["source"], pdf["extraction"], pdf["corrections"]):
                out, report = replay(Extraction(**json.loads(text)), [json.loads(c) for c in (todo if todo is not None else [])])
                rows.append((source, json.dumps({"entities": out.entities, "relationships": out.relationships}), json.dumps(report)))
            yield pd.DataFrame(rows, columns=["source", "extraction", "report"])

    return both.select("source", "extraction", "corrections").mapInPandas(run, "source string, extraction string, report string")


def with_groups(selected: DataFrame, corrections: DataFrame) -> DataFrame:
    """The selected corrections (column ord) and all other members of their groups."""
    groups = corrections.join(selected.select("ord"), "ord", "left_semi").where("grp is not null").select("grp").distinct()
    return corrections.join(selected.select("ord"), "ord", "left_semi").unionByName(corrections.join(groups, "grp", "left_semi").select(corrections.columns)).distinct()
