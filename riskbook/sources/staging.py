"""Cutting lineage with a written table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# Columns from which a row's method may outgrow what the JVM compiles.
WIDE = 24
_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its
    own, removed when Python ends; on a cluster the executors would not see one.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="riskbook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables staged inside the block, removed at its end.

    Results must be read or written elsewhere before the block ends.
    """
    folder = f"{checkpoint_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    folder = _RUN.get() or checkpoint_folder(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def split_methods(df: DataFrame) -> Iterator[None]:
    """Wide rows made by code that the JVM compiles; narrow ones are left alone.

    One method makes all columns of a row. Beyond 8,000 bytes the JVM only
    interprets it; with that limit Spark splits such a method into small ones.
    """
    spark = df.sparkSession
    before = spark.conf.get(_METHOD_LIMIT)
    if len(df.columns) < WIDE or int(before) <= 8000:
        yield
        return
    spark.conf.set(_METHOD_LIMIT, 8000)
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the table as Parquet once and go on from the files.

    Unlike a cache it survives lost executors, and unlike an RDD checkpoint
    each later read loads only the columns it uses.
    """
    path = new_path(df.sparkSession, name)
    with split_methods(df):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_observed(
    df: DataFrame, name: str, metrics: dict[str, Column], columns: Sequence[str] | None = None
) -> tuple[DataFrame, dict[str, Any]]:
    """stage() of some columns, and aggregates over the rows taken by the pass that writes them."""
    observation = Observation(name)
    observed = df.observe(observation, *[metric.alias(label) for label, metric in metrics.items()])
    staged = stage(observed if columns is None else observed.select(*columns), name)
    return staged, observation.get
