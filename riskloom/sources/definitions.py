"""Flag definitions from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = (
    "flags array<struct<flag_id: int, detection_agent: map<string, string>, "
    "orchestrator: map<string, string>>>"
)


def load_flag_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(flag_id, detection_agent, orchestrator), one row per flag."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.inline("flags"))


def definitions_for(definitions: DataFrame, flag_ids: list[int], part: str = "detection_agent") -> DataFrame:
    """One part of the definitions of the given flags; an absent part is empty."""
    empty = F.create_map().cast("map<string,string>")
    return definitions.where(F.col("flag_id").isin(flag_ids)).select(
        "flag_id", F.coalesce(F.col(part), empty).alias(part)
    )
