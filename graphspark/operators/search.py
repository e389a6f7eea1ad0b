"""Keyword and concept search over vertices or documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.props import is_null
from graphspark.functions.similarity import cosine

SIDE, SHOWN = 40, 200
THRESHOLD = 0.5


def searchable(label: Column, summary: Column, properties: Column | None = None, data: Column | None = None) -> Column:
    """Label, summary, text properties and data as one lower-cased text."""
    parts = [label, summary]
    if properties is not None:
        parts.append(F.array_join(F.filter(F.transform(F.map_values(properties), lambda v: v["s"]), lambda s: s.isNotNull()), " "))
    if data is not None:
        parts.append(data)
    return F.lower(F.concat_ws(" ", *parts))


def keyword_score(text: Column, query: str) -> Column:
    """The share of the query's words that the (lower-cased) text contains."""
    terms = [t for t in query.lower().split() if t]
    if not terms:
        return F.lit(0.0)
    return sum((F.contains(text, F.lit(t)).cast("double") for t in terms), F.lit(0.0)) / len(terms)


def keyword_search(frame: DataFrame, text: Column, query: str, limit: int | None = None) -> DataFrame:
    """The rows that contain a word of the query, with their score; the best first if limited, ties by id."""
    found = frame.withColumn("score", F.coalesce(keyword_score(text, query), F.lit(0.0))).where("score > 0")
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def token_search(frame: DataFrame, text: Column, token: str) -> DataFrame:
    """The rows whose text has the token as a whole word."""
    return frame.where(F.array_contains(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), token.lower()))


def token_rank(frame: DataFrame, text: Column, query: str, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """The rows that hold a word of the query, with their relevance as score: each word's share of the row's words times
    the logarithm of its rarity, summed; the best first, ties by id. Signs in the query separate words and mean nothing
    else."""
    words = sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})
    held = frame.withColumn("_w", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    count = lambda x: F.size(F.filter("_w", lambda w: w == F.lit(x)))
    counts = [count(x) for x in words]
    if not words:
        return frame.withColumn("score", F.lit(0.0)).where("false")
    seen = held.agg(F.count(F.lit(1)).alias("n"), *[F.sum((c > 0).cast("long")).alias(f"d{i}") for i, c in enumerate(counts)])
    rarity = seen.select(*[F.log(1 + F.col("n") / F.greatest(F.col(f"d{i}"), F.lit(1))).alias(f"r{i}") for i in range(len(words))])
    score = sum((F.col(f"r{i}") * c / F.greatest(F.size("_w"), F.lit(1)) for i, c in enumerate(counts)), F.lit(0.0))
    found = held.crossJoin(F.broadcast(rarity)).withColumn("score", score).where("score > 0").select(*[F.col(f"`{c}`") for c in frame.columns], "score")
    return found if limit is None else found.orderBy(F.desc("score"), id_col).limit(limit)


def full_text_join(frame: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of frame that an outside full-text index found: keys (key, rank); the best rank first in column rank."""
    best = keys.groupBy(F.col("key").alias(id_col)).agg(F.max("rank").alias("rank"))
    return frame.join(best, id_col)


def highlight(field: Column, query: str, shown: int | None = SHOWN) -> Column:
    """A snippet around the first word of the query that the field's first `shown` characters hold: 40 characters on
    either side, "..." where it is cut; null if none of the words is there."""
    field = F.substring(field, 1, shown) if shown else field
    out = F.lit(None).cast("string")
    for term in reversed([t for t in query.lower().split() if t]):
        at = F.instr(F.lower(field), term) - 1
        lo = F.greatest(F.lit(0), at - SIDE)
        hi = F.least(F.length(field), at + len(term) + SIDE)
        cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(field, lo + 1, hi - lo), F.when(hi < F.length(field), "...").otherwise(""))
        out = F.when(at >= 0, cut).otherwise(out)
    return F.when(field.isNotNull(), out)


def highlights(frame: DataFrame, query: str, fields: dict[str, Column]) -> DataFrame:
    """frame with a column hl_<name> for each field."""
    return frame.withColumns({f"hl_{k}": highlight(c, query) for k, c in fields.items()})


def concept_search(frame: DataFrame, vector: list[float], threshold: float = THRESHOLD, limit: int | None = None, column: str = "embedding", id_col: str = "id") -> DataFrame:
    """Rows whose vector has a cosine of at least `threshold` with the query's, with it as score. The query's
    vector is a literal, so this is a scan with a filter and, if limited, a top-k."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    found = frame.withColumn("score", cosine(F.col(column), query)).where(F.col("score") >= threshold)
    return found if limit is None else found.orderBy(F.desc("score"), id_col).limit(limit)


def with_storage_order(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the scores of hits (id, score); unmatched rows get 0 and come last."""
    return rows.join(hits.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def embedding_text(label: Column, summary: Column, properties: Column, embeddable: list[str]) -> Column:
    """Label, summary and the embeddable text properties; blanks left out."""
    parts = [label, summary, *(F.when(~is_null(properties[k]), properties[k]["s"]) for k in embeddable)]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), " ")


def hash_embedding(text: str, dims: int = 8) -> list[float]:
    """A deterministic stand-in for an embedding service: code points summed by place, scaled to length 1."""
    out = [0.0] * dims
    for i, ch in enumerate(text.lower()):
        out[i % dims] += ord(ch) / 128.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def embedder(embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> Callable[[Column], Column]:
    """A pandas UDF that embeds texts in batches of at most `batch`, by any function of a list of texts."""
    call = embed or (lambda texts: [hash_embedding(t) for t in texts])

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in call(texts[i : i + batch])])

    return run
