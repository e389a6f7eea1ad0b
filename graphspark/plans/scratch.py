"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when a count showed that it has no more rows than this; else it is joined by shuffle.
BROADCAST_ROWS = 200_000

_fallback: dict[str, str] = {}
_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and the master is local, a temporary folder is made:
    the executors of a cluster do not see the driver's."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _fallback.setdefault("dir", tempfile.mkdtemp(prefix="graphspark-"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: cuts the lineage, and a lost executor
    costs no more than a reread."""
    path = f"{scratch_root(df.sparkSession)}/graphspark/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    for scope in _scopes:
        scope.append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextlib.contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """On leaving deletes the intermediate tables that were written meanwhile; frames that read them must be done with,
    or stored before as rows of their own outside."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in mine:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def size_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most `limit` rows, df itself otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the folder; frames that still read them become unusable."""
    delete(spark, f"{scratch_root(spark)}/graphspark")
