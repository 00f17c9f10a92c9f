"""Model results: long and wide forms, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom import fixed

LONG = ["random_state", "model", "grp", "metric", "value"]


def results_long(wide: DataFrame, index: str = "random_state") -> DataFrame:
    """`{model}_{group}_{metric}` columns to rows.

    Names are split by the known models and metrics: `bert_mlp` and `pr_auc`
    contain the separator themselves.
    """
    columns = [c for c in wide.columns if c != index]
    models = "|".join(sorted(fixed.MODEL_FILES, key=len, reverse=True))
    pattern = f"^({models})_(.+)_({'|'.join(fixed.METRICS)})$"
    long = wide.select(index, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [index], columns, "name", "value"
    )
    return long.where(F.col("name").rlike(pattern)).select(
        F.col(index).cast("bigint").alias("random_state"),
        *[
            F.regexp_extract("name", pattern, i).alias(part)
            for i, part in enumerate(("model", "grp", "metric"), start=1)
        ],
        "value",
    )


def results_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One row per random state, one column per name in `names`.

    The names are given, so the pivot needs no extra pass to find them.
    """
    named = long.withColumn("name", F.concat_ws("_", "model", "grp", "metric"))
    return named.groupBy("random_state").pivot("name", names).agg(F.first("value"))


def result_names(models: list[str], groups: list[str]) -> list[str]:
    return [f"{m}_{g}_{k}" for m in models for g in groups for k in fixed.METRICS]


def summary_means(long: DataFrame) -> DataFrame:
    """Mean of each metric by model and group, metrics as columns."""
    return (
        long.groupBy("model", "grp")
        .pivot("metric", fixed.METRICS)
        .agg(F.avg("value"))
        .select("model", "grp", *fixed.METRICS)
    )


def named_models(df: DataFrame) -> DataFrame:
    """Replace model short names by their display names."""
    table = F.create_map(*[F.lit(v) for pair in fixed.MODEL_FILES.items() for v in pair])
    return df.withColumn("model", F.coalesce(F.try_element_at(table, F.col("model")), F.col("model")))
