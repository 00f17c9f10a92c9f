"""Paired comparison of feature groups over the same random states."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom import fixed
from riskloom.functions.columns import ratio
from riskloom.functions.pvalues import student_975, student_two_sided_p

TEST = ["model", "comparison", "group_a", "group_b", "metric"]


def pair_groups(long: DataFrame, pairs=fixed.COMPARED_PAIRS) -> DataFrame:
    """(model, comparison, groups, metric, random_state, a, b) rows.

    One aggregation puts a state's groups side by side, then the pairs are
    formed on the row; a pair whose group is missing yields nothing.
    """
    groups = sorted({g for a, b, _ in pairs for g in (a, b)})
    side = long.groupBy("model", "metric", "random_state").agg(
        *[F.max(F.when(F.col("grp") == g, F.col("value"))).alias(f"_{g}") for g in groups]
    )
    formed = F.array(
        *[
            F.struct(
                F.lit(name).alias("comparison"), F.lit(a).alias("group_a"),
                F.lit(b).alias("group_b"), F.col(f"_{a}").alias("a"), F.col(f"_{b}").alias("b"),
            )
            for a, b, name in pairs
        ]
    )
    return side.select("model", "metric", "random_state", F.inline(formed)).where(
        "a is not null and b is not null"
    )


def paired_moments(pairs: DataFrame) -> DataFrame:
    """Per test: n, means, mean and sample deviation of b - a."""
    diff = F.col("b") - F.col("a")
    return pairs.groupBy(*TEST).agg(
        F.count(F.lit(1)).alias("n_iters"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(diff).alias("mean_diff"),
        F.stddev_samp(diff).alias("sd_diff"),
    )


def cohens_d(moments: DataFrame) -> DataFrame:
    return moments.withColumn(
        "cohens_d",
        F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff")).otherwise(0.0),
    )


def paired_t(moments: DataFrame) -> DataFrame:
    """Add t and its two-sided p. Constant differences give an infinite t, or
    null when they are all zero."""
    error = F.col("sd_diff") / F.sqrt(F.col("n_iters").cast("double"))
    constant = F.when(F.col("mean_diff") != 0, F.signum("mean_diff") * float("inf"))
    t = F.when(F.col("sd_diff") == 0, constant).otherwise(F.try_divide(F.col("mean_diff"), error))
    return moments.withColumn("t_statistic", t).withColumn(
        "p_value", student_two_sided_p("t_statistic", F.col("n_iters") - 1)
    )


def paired_ci(moments: DataFrame) -> DataFrame:
    """Add the 95 % interval of the mean difference."""
    margin = student_975(F.col("n_iters") - 1) * F.col("sd_diff") / F.sqrt(
        F.col("n_iters").cast("double")
    )
    return moments.withColumn("_margin", margin).withColumns({
        "ci_95_lower": F.col("mean_diff") - F.col("_margin"),
        "ci_95_upper": F.col("mean_diff") + F.col("_margin"),
    }).drop("_margin")


def mark_significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    return tests.withColumn(
        "significant", F.when(F.col("p_value") < level, "Yes").otherwise("No")
    )


def compare_groups(long: DataFrame, pairs=fixed.COMPARED_PAIRS) -> DataFrame:
    """The whole comparison table, unrounded."""
    moments = paired_moments(pair_groups(long, pairs))
    return mark_significant(paired_ci(paired_t(cohens_d(moments))))


def _significance(tests: DataFrame, by: str) -> DataFrame:
    counts = tests.groupBy(by).agg(
        F.count(F.when(F.col("significant") == "Yes", 1)).alias("significant"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumn(
        "pct", F.bround(ratio(F.col("significant"), F.col("total")) * 100.0, 1)
    )


def significance_counts(tests: DataFrame) -> DataFrame:
    return _significance(tests, "comparison")


def model_significance(tests: DataFrame) -> DataFrame:
    return _significance(tests, "model").drop("pct")


def union_results(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
