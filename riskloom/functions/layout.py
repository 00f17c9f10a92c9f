"""Spreading rows over idle cores, and how many go to Python at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BATCH_BYTES, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes of a batch of rows that goes to Python, unless the session has its own bound."""
    if spark.conf.get(_BATCH_BYTES) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_BYTES, str(most))


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Repartition by key into `partitions`; by default only when the rows come in
    fewer partitions than there are cores, which would leave cores idle.

    For work that costs much per row (reading words, hashing a row for many
    seeds). Rows in enough partitions are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions is None and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(partitions or cores, key)
