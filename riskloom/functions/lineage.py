"""Cutting lineage so that lost executors cost little."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate rows go: the folder `spark.checkpoint.dir` names, which all
    executors share. Only a local session without that setting writes below its warehouse."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read on from there. Inside `scratch`
    they are deleted at its end."""
    spark = df.sparkSession
    folder = f"{_run.get() or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Everything `cut` writes inside goes to a folder of its own, deleted at the end.

    For work whose results leave as values or models, not as lazy rows.
    """
    folder = f"{_run.get() or shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
