"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs on one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratagraph-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def fresh_dir(spark: SparkSession, what: str) -> str:
    """The URI of a new folder's place below the shared one; it isn't made yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    return path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """A Parquet table in the shared folder, read again: for what is read several times by type or column.

    Unlike a checkpoint it is columnar, can be pruned (by folder for the columns ``by``, whose rows are dealt out so
    that each has few files and a frequent one several) and filtered, and its size is known to the planner.
    """
    path = fresh_dir(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        if by:
            df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
        else:
            df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
