"""Scoring records as their files arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from riskloom.functions.shipping import ship

_STORE = "spark.sql.streaming.stateStore"
# Keys live on the executors' disks, and a batch saves only what it changed.
_STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
_DIGEST = "digest of the row"


class FirstBatchOfKey(StatefulProcessor):
    """Lets a key's rows through in the first batch that has it: of these the one with the
    smallest digest. The state remembers the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda row: row[_DIGEST])
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """A stream keeps the settings it starts with; the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def first_of_each_key(rows: DataFrame, key: str, scored: DataFrame | None = None) -> DataFrame:
    """The stream's rows whose key no earlier batch had, one for each key.

    Of rows with the same key in a batch the one with the smallest digest is taken, so a
    repeated batch takes the same. Work and state changes of a batch follow its rows.
    Keys in `scored` count as seen from the start.
    """
    ship(rows.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    digested = rows.withColumn(_DIGEST, F.sha2(F.to_json(row), 256))
    known = None if scored is None else scored.select(key).distinct().groupBy(key)
    fresh = digested.groupBy(key).transformWithState(FirstBatchOfKey(), digested.schema, "Append", "None", known)
    return fresh.drop(_DIGEST)


def score_arriving(
    spark: SparkSession,
    source: str,
    schema: StructType,
    key: str,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files: int | None = None,
    scored: DataFrame | None = None,
) -> StreamingQuery:
    """Score every record that has no result yet and stop when caught up.

    Which keys have one is the state of the stream, kept with its checkpoint: no batch
    reads what others wrote. `scored` has keys with a result from elsewhere; it is read
    by the first batch only. Each micro-batch overwrites its own `batch_id` folder, and
    a failed batch leaves the state as it was, so a batch repeated after a failure leaves the
    same rows. The checkpoint fixes the number of state partitions
    (`spark.sql.shuffle.partitions` at the first start).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    with _settings(spark, _STATE):
        return (
            first_of_each_key(reader.load(source), key, scored)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
