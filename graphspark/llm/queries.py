"""The queries over the synthetic tables that apply the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm import classifier, decontam, html_text, jaccard, mixing, pii, quality, sharding, tokens, unit_dedup

#: Shards and slots of the sharding query.
SHARDS, SLOTS = sharding.shard_names(64), 10_007
VOCABULARY = "byte_bpe_50k.json"
#: Words of a repeated passage that begins or ends inside a line: cut at sentences, over 50 words leave 25 at least.
PASSAGE_WORDS = 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            base = [[s for s in x if not s["added"]] for x in spans]
            counts = [pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64()) for k in pii.KINDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([pii.sha256_hex(pii.digest(x)) for x in base]), pa.array([pii.digest(x) for x in spans]), pa.array([len(x) - len(y) for x, y in zip(spans, base)], pa.int64()), pa.array([len(x) for x in spans], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op3_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op5_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return planned.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("positions") > 0, F.col("positions")[0]).alias("first_position"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_tokens=12, identity=0.8)


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = unit_dedup.dedup(_table(spark, sf_dir, "documents"), passages=PASSAGE_WORDS)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "text", "changed", "n_units", F.size("removed").alias("n_removed"), joined("removed").alias("removed"), joined("kept").alias("kept"), (F.col("longest") >= PASSAGE_WORDS).alias("passage"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS, SLOTS)
    return placed.select("doc_id", "slot", "shard", "shard_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_pii_spans, op3_jaccard_classes, op4_quality_rules, op5_quality_score, op6_source_mix, op7_decontaminate, op8_unit_dedup, op9_html_text, op10_shards)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Only the sharding's placement can be said in SQL; its lookup table is filled by rule and written out."""
    table = ", ".join(map(str, sharding.lookup_table(SHARDS, SLOTS)))
    op10 = f"""
    WITH t AS (SELECT [{table}] AS shards),
    s AS (SELECT doc_id, CAST(COALESCE(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) % {SLOTS}, 0) AS INTEGER) AS slot FROM documents)
    SELECT doc_id, slot, CAST(t.shards[slot + 1] AS INTEGER) AS shard, 'shard-' || lpad(CAST(t.shards[slot + 1] AS VARCHAR), 5, '0') AS shard_name FROM s, t
    """
    return {"op10_shards": op10}
