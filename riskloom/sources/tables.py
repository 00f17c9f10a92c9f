"""Writing tables, and cached embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    writer = df.write.mode("overwrite").options(**options)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("encoding", "UTF-8")
    writer.format(fmt).save(path)


def write_scored(df: DataFrame, path: str, source: str | None = None, fmt: str = "parquet") -> None:
    """Write the table with its result columns to a new place.

    Spark reads lazily: writing over the source would destroy it mid-read.
    """
    if source and path.rstrip("/") == source.rstrip("/"):
        raise ValueError("scored rows must go to a new path, not over their source")
    write_table(df, path, fmt)


def write_embeddings(df: DataFrame, path: str, key: str) -> None:
    df.select(key, F.col("embedding").cast("array<float>").alias("embedding")).write.mode(
        "overwrite"
    ).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached vectors, or None when there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached_embeddings(
    spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Reuse the vectors at `path`; build and write them when absent."""
    found = read_embeddings(spark, path)
    if found is None:
        write_embeddings(build(), path, key)
        found = read_embeddings(spark, path)
    return found
