"""Positions and running totals over an order, without a one-task window.

A global window sorts the whole table in one task. Here rows are first cut
into value ranges at split points, as many as the session has shuffle
partitions; each range is windowed on its own, and the range totals carry the
offsets across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

SAMPLE_PER_RANGE = 64


def split_points(df: DataFrame, column: str, ranges: int | None = None) -> list:
    """Values that cut `column` into ranges of similar size, by default as many
    as the session has shuffle partitions.

    Numbers: approximate quantiles in one pass. Other types: a sample whose
    expected size is ranges x 64 values. The points only steer the layout: any
    points give the same results.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = df.select(column).where(F.col(column).isNotNull())
    if isinstance(df.schema[column].dataType, T.NumericType):
        steps = [i / ranges for i in range(1, ranges)]
        row = values.agg(F.percentile_approx(column, steps, 4 * ranges).alias("cuts")).first()
        return sorted(set(row["cuts"] or []))
    total = max(1, values.count())
    share = min(1.0, ranges * SAMPLE_PER_RANGE / total)
    sampled = sorted(r[0] for r in values.sample(share, seed=17).collect())
    step = max(1, len(sampled) // ranges)
    return sorted(set(sampled[step::step]))


def range_of(column: Column, points: list) -> Column:
    """Number of split points at or below the value, as a balanced CASE tree."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < F.lit(points[mid]), search(low, mid)).otherwise(
            search(mid + 1, high)
        )

    return search(0, len(points))


def running_totals(
    df: DataFrame,
    order: str,
    totals: list[str],
    groups: list[str] = (),
    points: list | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add `<name>_before`: the sum of each total over the rows ordered before.

    `order` must be unique within a group (aggregate by it first). Without
    `points` a plain window is used: right for short scales such as 0..10.
    """
    groups = list(groups)
    by = F.col(order).desc() if descending else F.col(order).asc()
    before = W.unboundedPreceding, -1

    def window(keys, ordering):
        spec = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        return spec.orderBy(ordering).rowsBetween(*before)

    def sums(spec, suffix):
        return {
            f"{t}{suffix}": F.coalesce(F.sum(t).over(spec), F.lit(0)) for t in totals
        }

    if not points:
        return df.withColumns(sums(window(groups, by), "_before"))

    ranged = df.withColumn("_range", range_of(F.col(order), points))
    per_range = ranged.groupBy(*groups, "_range").agg(*[F.sum(t).alias(t) for t in totals])
    range_by = F.col("_range").desc() if descending else F.col("_range").asc()
    offsets = per_range.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_range").alias("_r"),
        *[c.alias(f"_{n}") for n, c in sums(window(groups, range_by), "_offset").items()],
    )
    match = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = ranged.withColumns(sums(window([*groups, "_range"], by), "_inside"))
    # One row per group and range, as many ranges as shuffle partitions: broadcast.
    joined = inside.join(F.broadcast(offsets), match)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"{t}_inside") + F.col(f"_{t}_offset")).alias(f"{t}_before")
            for t in totals
        ],
    )


def row_positions(df: DataFrame, key: str, points: list | None = None) -> DataFrame:
    """Add `position`: the 0-based place of each row in key order (unique key)."""
    points = split_points(df, key) if points is None else points
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), key, ["_one"], points=points)
    return counted.withColumnRenamed("_one_before", "position").drop("_one")


def keys_at(df: DataFrame, key: str, positions: list[int]) -> list:
    """Keys found at the given 0-based positions in key order."""
    if not positions:
        return []
    keys = df.select(key)
    points = split_points(keys, key)
    ranged = keys.withColumn("_range", range_of(F.col(key), points))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    wanted, start = {}, 0
    for rng in sorted(counts):
        inside = [p for p in positions if start <= p < start + counts[rng]]
        wanted.update({p: (rng, p - start) for p in inside})
        start += counts[rng]
    picks = ranged.where(F.col("_range").isin(sorted({r for r, _ in wanted.values()})))
    placed = picks.withColumn(
        "_at", F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    )
    hit = F.lit(False)
    for rng, at in set(wanted.values()):
        hit = hit | ((F.col("_range") == rng) & (F.col("_at") == at))
    found = {(r["_range"], r["_at"]): r[key] for r in placed.where(hit).collect()}
    return [found.get(wanted[p]) if p in wanted else None for p in positions]
