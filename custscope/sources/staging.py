"""Shared scratch space: written tables cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from custscope.sources import files

_open: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)
#: What holds inside a scratch: a write's shuffle files go when it ends, not when the driver happens to collect its garbage.
_TIGHT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def tight(spark: SparkSession) -> Iterator[None]:
    """Writes inside pack their tables tighter and leave no shuffle files behind."""
    before = {k: spark.conf.get(k, None) for k in _TIGHT}
    for k, v in _TIGHT.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end, so nothing that lives longer may read them; writes are `tight`."""
    mine: list[str] = []
    outer = _open.set(mine)
    try:
        with tight(spark):
            yield
    finally:
        _open.reset(outer)
        for path in mine:
            files.delete(spark, path)


def staging_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or a temporary one on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="custscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes the rows once and returns a DataFrame that scans the written table."""
    path = fresh_path(df.sparkSession, name)
    if (mine := _open.get()) is not None:
        mine.append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # The schema is given so that partition values keep their type and nothing is inferred.
    return df.sparkSession.read.schema(df.schema).parquet(path)
