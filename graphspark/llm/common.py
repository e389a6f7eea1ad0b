"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.plans.scratch import BROADCAST_ROWS, scratch_root, size_checked, stored
from graphspark.plans.ship import ship

#: Rows per Arrow batch sent to Python: with very long texts a batch stays within a worker's memory.
BATCH_ROWS = 512

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "mix64", "plain", "scratch_root", "size_checked", "small_batches", "stored", "texts_of"]


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session, and see that executors have the package. A smaller bound of the
    session's own stays. Batches are cut when a plan runs, so the bound cannot be taken back when it is built."""
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix64(h: np.ndarray, mult: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(mult)
    return h ^ (h >> np.uint64(29))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def plain(df: DataFrame, *cols: str | tuple[str, str | Column]) -> DataFrame:
    """Only the named columns: extra columns of any name stay out of the operator's way."""
    return df.select(*[F.col(f"`{c}`") if isinstance(c, str) else F.col(f"`{c[1]}`").alias(c[0]) for c in cols])
