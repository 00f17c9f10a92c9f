"""Model result files: `{MODEL}_results_{rsA-B}.csv`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import fixed
from riskloom.operators.results import result_names, results_long, results_wide

NAME = r"^([A-Za-z_]+)_results_(rs\d+-\d+)\.csv$"


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """(model_file, run, path) of the result tables in a folder: single files, or folders
    that Spark wrote. Only names are listed, a few dozen."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = [(m[1], m[2], e.getPath().toString()) for e in entries if (m := re.match(NAME, e.getPath().getName()))]
    return spark.createDataFrame(found, "model_file string, run string, path string")


def discover_result_sets(spark: SparkSession, folder: str) -> list[str]:
    """The distinct runs found, sorted as text."""
    return [r["run"] for r in result_files(spark, folder).select("run").distinct().orderBy("run").collect()]


def load_results(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Long results of a run; models without a file are skipped."""
    found = {
        r["model_file"]: r["path"]
        for r in result_files(spark, folder).where(F.col("run") == run).collect()
    }
    out = None
    for name in fixed.MODEL_FILES.values():
        if name in found:
            wide = spark.read.option("header", True).csv(found[name])
            long = results_long(wide)
            out = long if out is None else out.unionByName(long)
    if out is None:
        raise FileNotFoundError(f"no result files for {run} in {folder}")
    return out


def write_results(long: DataFrame, folder: str, run: str) -> None:
    """One wide CSV per model, in a folder named like the file.

    Names are taken from the data: a few dozen columns per model.
    """
    have = long.select("model", "grp").distinct().collect()
    for model, file in fixed.MODEL_FILES.items():
        groups = [g for g in fixed.FEATURE_GROUPS if any(r["model"] == model and r["grp"] == g for r in have)]
        if groups:
            wide = results_wide(long.where(F.col("model") == model), result_names([model], groups))
            wide.orderBy("random_state").coalesce(1).write.mode("overwrite").option("header", True).csv(
                f"{folder}/{file}_results_{run}.csv"
            )
