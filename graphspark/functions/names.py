"""Names: identifiers, type names, slugs, label keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def type_name(c: Column) -> Column:
    """Lower case, blanks and dashes and dots as one underscore, everything else dropped."""
    return _chain(F.lower(F.trim(c)), (r"[-\s.]+", "_"), (r"[^a-z0-9_]", ""))


def screaming_snake(c: Column) -> Column:
    """UPPER_CASE with underscores at the joints of camel case and acronyms; other marks are dropped."""
    joined = _chain(F.trim(c), (r"([a-z0-9])([A-Z])", "$1_$2"), (r"([A-Z]+)([A-Z][a-z])", "$1_$2"), (r"[-\s.]+", "_"), (r"[^A-Za-z0-9_]", ""), (r"_+", "_"), (r"^_|_$", ""))
    return F.upper(joined)


def slug(c: Column) -> Column:
    """Lower case, anything but letters and digits as one dash."""
    return _chain(F.lower(F.trim(c)), (r"[^a-z0-9]+", "-"), (r"^-+|-+$", ""))


def entity_slug(type_: Column, label: Column) -> Column:
    """"type:label" with the label as a slug, "unnamed" if that is empty."""
    s = slug(label)
    return F.concat_ws(":", type_, F.when(s == "", "unnamed").otherwise(s))


def label_key_text(label: str | None) -> str | None:
    """A label without accents, case and blanks around dashes and slashes."""
    if label is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", label) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"\s*([-/])\s*", r"\1", bare.lower())).strip()


@F.pandas_udf(T.StringType())
def label_key(labels: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """label_key_text() by Arrow batches: Spark has no normalisation to NFD."""
    for part in labels:
        yield part.map(label_key_text, na_action="ignore")


def is_identifier(name: str) -> bool:
    return bool(IDENTIFIER.match(name))


def hash32(c: Column) -> Column:
    """The 32-bit string hash h = h * 31 + code unit, signed, over UTF-16 code units below the surrogates."""
    chars = F.split(c, "")
    step = lambda h, ch: F.pmod(h * 31 + F.ascii(ch), F.lit(1 << 32))
    unsigned = F.aggregate(F.filter(chars, lambda ch: ch != ""), F.lit(0).cast("long"), lambda h, ch: step(h, ch).cast("long"))
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)
