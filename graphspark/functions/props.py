"""Typed property values and filters over them, as column expressions.

A bag is a map from key to a struct with one part for each type, so comparisons never cast: the text "1" differs from
the number 1, and a missing key differs from an explicit null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphspark.model import BAG

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "isNull", "isNotNull")


def text(c: Column) -> Column:
    return F.struct(c.cast("string").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("j"))


def number(c: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("s"), c.cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("j"))


def flag(c: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("d"), c.cast("boolean").alias("b"), F.lit(None).cast("string").alias("j"))


def literal(v: Any) -> Column:
    """A Python value as a property value."""
    if isinstance(v, bool):
        return flag(F.lit(v))
    if isinstance(v, (int, float)):
        return number(F.lit(float(v)))
    return text(F.lit(v))


def bag(**values: Column) -> Column:
    """A property bag with the given keys."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def empty_bag() -> Column:
    return F.create_map().cast(BAG)


def from_json(c: Column) -> Column:
    """A JSON object's top level as a bag; nested values keep their JSON text; null for anything else."""
    whole, keys = F.try_parse_json(c), F.json_object_keys(c)

    def typed(k: Column) -> Column:
        path = F.concat(F.lit("$['"), k, F.lit("']"))
        get = lambda kind: F.try_variant_get(whole, path, kind)
        kind = F.schema_of_variant(get("variant"))
        return F.struct(
            F.when(kind == "STRING", get("string")).alias("s"),
            F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), get("double")).alias("d"),
            F.when(kind == "BOOLEAN", get("boolean")).alias("b"),
            F.when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(get("variant"))).alias("j"),
        )

    return F.when(keys.isNotNull(), F.map_from_arrays(keys, F.transform(keys, typed)))


def to_json(c: Column) -> Column:
    """A bag as JSON, keys in order."""
    keys = F.array_sort(F.map_keys(c))
    quote = lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(quote(k), F.lit(":"), plain(c[k], quote))), ","), F.lit("}"))


def plain(v: Column, quote: Any = None) -> Column:
    """A value as text: JSON if quote is given, else the bare value; whole numbers without a fraction."""
    s = F.when(v["s"].isNotNull(), quote(v["s"])) if quote else v["s"]
    d = F.when(v["d"] == F.floor(v["d"]), v["d"].cast("decimal(38,0)").cast("string")).otherwise(v["d"].cast("string"))
    none = F.lit("null") if quote else F.lit(None).cast("string")
    return F.coalesce(s, d, v["b"].cast("string"), v["j"], none)


def is_null(v: Column) -> Column:
    """Missing, or an explicit null."""
    return v.isNull() | (v["s"].isNull() & v["d"].isNull() & v["b"].isNull() & v["j"].isNull())


def _equal(v: Column, to: Any) -> Column:
    if to is None:
        return v.isNotNull() & is_null(v)
    part = "b" if isinstance(to, bool) else "d" if isinstance(to, (int, float)) else "s"
    return v[part] == F.lit(float(to) if part == "d" else to)


@dataclass(frozen=True)
class Filter:
    """key operator value; the operators are OPERATORS."""

    key: str
    op: str = "eq"
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")

    def on(self, props: Column) -> Column:
        """True if the filter holds, else false or null: as a condition that reaches the scan. neq holds for a missing
        key; comparisons of unlike types fail."""
        v, to = props[self.key], self.value
        if self.op == "isNull":
            return is_null(v)
        if self.op == "isNotNull":
            return ~is_null(v)
        if self.op == "eq":
            return _equal(v, to)
        if self.op == "neq":
            return ~F.coalesce(_equal(v, to), F.lit(False))
        if isinstance(to, bool) or to is None:
            return F.lit(False)
        if self.op == "contains":
            return F.contains(F.lower(v["s"]), F.lit(to.lower())) if isinstance(to, str) else F.lit(False)
        side, lit = (v["s"], F.lit(to)) if isinstance(to, str) else (v["d"], F.lit(float(to)))
        return {"gt": side > lit, "gte": side >= lit, "lt": side < lit, "lte": side <= lit}[self.op]


def all_of(filters: list[Filter] | tuple[Filter, ...], props: Column) -> Column:
    return reduce(lambda a, b: a & b, [f.on(props) for f in filters], F.lit(True))
