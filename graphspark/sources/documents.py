"""Documents as sources: folders of files, web pages as text, extraction answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators.text import salvaged

EXTRACTION = "struct<entities:array<struct<entityType:string,label:string,summary:string,properties:map<string,string>,aliases:array<string>>>,relationships:array<struct<type:string,sourceLabel:string,targetLabel:string,properties:map<string,string>>>>"
# File endings that need a conversion before they are text.
CONVERTED = ("pdf", "docx", "pptx", "xlsx", "html", "htm", "png", "jpg", "jpeg", "tiff")


def source_list(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, ending, bytes, modified, hash and status of the files below a folder; contents are read for the hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", ending.alias("ending"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), F.when(ending.isin(*CONVERTED), "needs-conversion").otherwise("pending").alias("status"))


def changed_sources(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the earlier list."""
    return now.join(before.select("path", F.col("hash").alias("_old")), "path", "left").where("_old is null or _old <> hash").drop("_old")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text, one row for each file."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def matching_sources(sources: DataFrame, filters: list[str]) -> DataFrame:
    """Sources whose path holds one of the texts; all without any."""
    return sources.where(F.exists(F.array(*[F.lit(f) for f in filters]), lambda f: F.contains(F.col("path"), f))) if filters else sources


def plain_text(page: str) -> Column:
    """A page's visible text by expressions: comments, scripts, styles and tags removed, common references decoded,
    white space joined."""
    c = F.col(page)
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<(script|style|head)\b.*?</\1>", r"(?s)<[^>]*>"):
        c = F.regexp_replace(c, pattern, " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def extraction_rows(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships (source, ord, ...) of answers (source, answer); cut-off answers are salvaged."""
    parsed = answers.select("source", F.from_json(salvaged("answer"), EXTRACTION).alias("x"))
    entities = parsed.select("source", F.posexplode("x.entities").alias("ord", "e")).select("source", "ord", F.col("e.entityType").alias("type"), "e.label", "e.summary", "e.properties", "e.aliases")
    relationships = parsed.select("source", F.posexplode("x.relationships").alias("ord", "r")).select("source", "ord", "r.type", F.col("r.sourceLabel").alias("source_label"), F.col("r.targetLabel").alias("target_label"), "r.properties")
    return entities, relationships
