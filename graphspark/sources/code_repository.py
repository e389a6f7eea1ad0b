"""A graph of a code repository: modules, their imports, packages and test files, from the files' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions.props import bag, empty_bag, number, text
from graphspark.model import BAG, Graph

# Patterns of import statements by file ending.
IMPORTS = {
    "ts": r"""(?m)^\s*(?:import|export)\b[^;'"]*?from\s+['"]([^'"]+)['"]""",
    "js": r"""(?m)^\s*(?:import|export)\b[^;'"]*?from\s+['"]([^'"]+)['"]""",
    "mjs": r"""(?m)^\s*(?:import|export)\b[^;'"]*?from\s+['"]([^'"]+)['"]""",
    "py": r"(?m)^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))",
}
ERRORS = r"(?m)^\s*export\s+class\s+(\w+Error)\b"


def files(spark: SparkSession, folder: str, endings: tuple[str, ...] = tuple(IMPORTS)) -> DataFrame:
    """path (below the folder), ending and text."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").text(folder)
    # the folder as the file system names it, so that any scheme, or none, may be given
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")
    path = F.regexp_replace(local(F.input_file_name()), F.concat(F.lit(r"^\Q"), local(F.lit(base)), F.lit(r"\E/+")), F.lit(""))
    return raw.select(path.alias("path"), F.col("value").alias("text")).withColumn("ending", F.regexp_extract("path", r"\.(\w+)$", 1))


def imports(rows: DataFrame) -> DataFrame:
    """path and target of each import statement; relative targets are resolved against the file's folder."""
    found = F.array().cast("array<string>")
    for ending, pattern in IMPORTS.items():
        groups = [F.regexp_extract_all("text", F.lit(pattern), g) for g in range(1, 3 if ending == "py" else 2)]
        found = F.when(F.col("ending") == ending, F.filter(F.flatten(F.array(*groups)), lambda x: x != "")).otherwise(found)
    each = rows.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.explode(F.array_distinct(found)).alias("said"))
    base = F.when(F.col("said").startswith("."), F.concat_ws("/", F.filter(F.array("folder", "said"), lambda x: x != ""))).otherwise(F.col("said"))
    target = base
    for _ in range(8):  # a/../ and ./ go, one level at a time
        target = F.regexp_replace(F.regexp_replace(target, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return each.select("path", "said", target.alias("target"))


def code_graph(spark: SparkSession, folder: str) -> Graph:
    """Modules (and outside packages) as vertices, IMPORTS and TESTS as edges."""
    rows = files(spark, folder)
    stem = lambda c: F.regexp_replace(c, r"\.(ts|js|mjs|py)$", "")
    test = F.col("path").rlike(r"(\.test\.|\.spec\.|(^|/)test_)")
    modules = rows.select(F.concat(F.lit("module:"), stem(F.col("path"))).alias("id"), F.when(test, "Test").otherwise("Module").alias("type"), F.col("path").alias("label"), bag(lines=number(F.size(F.split("text", "\n"))), ending=text(F.col("ending"))).cast(BAG).alias("properties"))
    links = imports(rows)
    inside = links.select(F.concat(F.lit("module:"), stem(F.col("path"))).alias("source_id"), F.when(F.col("said").startswith("."), F.concat(F.lit("module:"), stem(F.col("target")))).otherwise(F.concat(F.lit("package:"), F.col("said"))).alias("target_id"))
    packages = inside.where(F.col("target_id").startswith("package:")).select(F.col("target_id").alias("id")).distinct().select("id", F.lit("Package").alias("type"), F.expr("substring(id, 9)").alias("label"), empty_bag().alias("properties"))
    edges = inside.distinct().select(F.concat_ws(">", F.lit("IMPORTS"), "source_id", "target_id").alias("id"), F.lit("IMPORTS").alias("type"), "source_id", "target_id", empty_bag().alias("properties"), F.lit(False).alias("bidirectional"))
    tests = modules.where("type = 'Test'").select("id", F.regexp_replace("id", r"\.(test|spec)$", "").alias("target_id"))
    checked = tests.join(modules.select(F.col("id").alias("target_id")), "target_id", "left_semi").where("id <> target_id")
    edges = edges.unionByName(checked.select(F.concat_ws(">", F.lit("TESTS"), "id", "target_id").alias("id"), F.lit("TESTS").alias("type"), F.col("id").alias("source_id"), "target_id", empty_bag().alias("properties"), F.lit(False).alias("bidirectional")))
    return Graph(modules.unionByName(packages).withColumn("summary", F.lit(None).cast("string")), edges)


def error_classes(rows: DataFrame) -> DataFrame:
    """path and name of the error classes that files define."""
    return rows.select("path", F.explode(F.regexp_extract_all("text", F.lit(ERRORS), 1)).alias("name"))
