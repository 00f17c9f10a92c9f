"""Intermediate tables in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.functions.shipping import ship

# Tables of at most this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
# What a row takes in a broadcast table besides its values.
_ROW_BYTES = 32


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one `spark.checkpoint.dir` names.

    Only a local session without that setting writes below its warehouse.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/llm"
    return f"{base}/{uuid.uuid4().hex}"


# Whether a job's shuffle files go as soon as it is done.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _put(df: DataFrame, folder: str, **options: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, "false")
    # The rows are read from the files from here on, never again from the shuffles that made them.
    conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(folder)
    finally:
        conf.set(_FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows to the shared folder and read on from there: later steps do
    not repeat the work, survive lost executors, and plan with the real size."""
    return _put(df, shared_folder(df.sparkSession), **options)


@contextmanager
def written_for_now(df: DataFrame) -> Iterator[DataFrame]:
    """`written`, but the files are deleted at the end: for large rows that only a few steps read."""
    folder = shared_folder(df.sparkSession)
    try:
        yield _put(df, folder)
    finally:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """The bytes of a table's values, measured: texts, binaries and lists by what they hold."""
    fixed, varying = _ROW_BYTES, []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            varying.append(F.octet_length(column))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            varying.append(F.octet_length(F.to_json(F.struct(column))))
        fixed += 8
    held = F.coalesce(F.sum(sum((F.coalesce(c, F.lit(0)) for c in varying), F.lit(0)).cast("long")), F.lit(0))
    row = df.agg(F.count("*").alias("n"), held.alias("held")).first()
    return row["n"] * fixed + row["held"]


def few(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a written table for broadcast when its measured size allows it; the result of a
    join is the same either way."""
    return F.broadcast(df) if size_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df


_BATCH_BYTES, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """The table, after sending this package to the executors and bounding the bytes of a
    batch of rows that goes to Python.

    Spark's 64 MB of text become several times as much in each worker. A bound
    that the session sets itself is kept.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES) == _SPARK_DEFAULT:
        conf.set(_BATCH_BYTES, str(most))
    return df


def pieces(batches: Iterable[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches in slices of a few rows, so that what a task makes of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the operator's own names, whatever else the table has."""
    return bounded_batches(df).select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def new_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as the table's columns (in any case) call for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo `divisor`; a null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor
