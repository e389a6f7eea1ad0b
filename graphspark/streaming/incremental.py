"""Incremental import: a stream of archive rows upserted batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphspark.plans.scratch import scratch_root


def latest(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def upsert_into(path: str, key: str = "id", order: str = "ord") -> Callable[[DataFrame, int], None]:
    """A batch function that appends each batch's last rows by key under `path`, in a folder of the batch's number; a
    batch that is replayed writes its folder again, so the result is the same. current() merges the batches on
    reading, and compact() on disk, so a batch costs what it holds and not what the table holds."""

    def run(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return run


def current(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The table's rows: of each key the one of the latest batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    # a maximum by batch is combined on the map side; whole rows travel once
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("row"))
    return last.select("row.*")


def import_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str | None = None, form: str = "json", every: str | None = None) -> StreamingQuery:
    """Starts to import the files of a folder into `target`: those there now, or with `every` (an interval) also those to
    come until the query is stopped."""
    rows = spark.readStream.schema(schema).format(form).load(folder)
    place = checkpoint or f"{scratch_root(spark)}/graphspark/stream-{hashlib.sha256(f'{folder}>{target}'.encode()).hexdigest()[:16]}"
    out = rows.writeStream.foreachBatch(upsert_into(target)).option("checkpointLocation", place)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours", time: str = "ts") -> DataFrame:
    """Number and sum of events by window and type; events later than `lateness` are dropped by the watermark."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    return stamped.withWatermark("_t", lateness).groupBy(F.window("_t", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
