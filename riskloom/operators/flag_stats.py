"""Flag prevalence, association with the label, and flags per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom import fixed
from riskloom.functions.columns import add_up, half_even, ratio, significance_stars
from riskloom.functions.pvalues import chi2_1dof_p, fisher_p


def base_rate(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("positives"),
    ).withColumn("rate_pct", ratio(F.col("positives"), F.col("n")) * 100.0)


def contingency(
    df: DataFrame, flags: list[str] = fixed.FLAGS, label: str = fixed.LABEL
) -> DataFrame:
    """Per flag the 2x2 counts of the labelled records: n11 flagged positive,
    n10 flagged negative, n01 unflagged positive, n00 unflagged negative."""
    return _counted(df, flags, label).drop("flagged", "records", "positives")


def _counted(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """The 2x2 counts, and over all records, labelled or not: how many have the
    flag, how many there are, and how many are positive.

    One pass with conditional sums; rows are not multiplied by the flags.
    """
    present = [f for f in flags if f in df.columns]
    hit, known = F.col(label) == 1, F.col(label).isNotNull()
    counts = [
        F.count(F.lit(1)).alias("records"), F.count(F.when(known, 1)).alias("n"),
        F.count(F.when(hit, 1)).alias("p"),
    ]
    for f in present:
        counts += [
            F.count(F.when(F.col(f) == 1, 1)).alias(f"{f}__all"),
            F.count(F.when((F.col(f) == 1) & known, 1)).alias(f"{f}__n"),
            F.count(F.when((F.col(f) == 1) & hit, 1)).alias(f"{f}__p"),
        ]
    rows = [
        F.struct(
            F.lit(f).alias("flag"),
            F.col(f"{f}__p").alias("n11"),
            (F.col(f"{f}__n") - F.col(f"{f}__p")).alias("n10"),
            (F.col("p") - F.col(f"{f}__p")).alias("n01"),
            (F.col("n") - F.col("p") - F.col(f"{f}__n") + F.col(f"{f}__p")).alias("n00"),
            F.col(f"{f}__all").alias("flagged"), F.col("records"), F.col("p").alias("positives"),
        )
        for f in present
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def _margins() -> dict[str, Column]:
    cell = {c: F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00")}
    return {
        **cell,
        "with_flag": cell["n11"] + cell["n10"],
        "without_flag": cell["n01"] + cell["n00"],
        "positive": cell["n11"] + cell["n01"],
        "negative": cell["n10"] + cell["n00"],
        "n": cell["n11"] + cell["n10"] + cell["n01"] + cell["n00"],
    }


def expected_cells(tables: DataFrame) -> DataFrame:
    """Add the smallest expected cell and the test it calls for.

    A row or column without records has no cells: a flag that every record has
    leaves a table of one row, for which the chi-square test gives p = 1.
    """
    m = _margins()
    smallest = F.least(
        *[
            F.when((m[r] > 0) & (m[c] > 0), m[r] * m[c] / m["n"])
            for r in ("with_flag", "without_flag") for c in ("positive", "negative")
        ]
    )
    return tables.withColumn("expected_min", smallest).withColumn(
        "test", F.when(F.col("expected_min") < 5, "Fisher").otherwise("Chi-sq")
    )


def chi2_yates(tables: DataFrame) -> DataFrame:
    """Add the 2x2 chi-square statistic with continuity correction."""
    m = _margins()
    gap = F.greatest(
        F.lit(0.0), F.abs(m["n11"] * m["n00"] - m["n10"] * m["n01"]) - m["n"] / 2.0
    )
    bottom = m["with_flag"] * m["without_flag"] * m["positive"] * m["negative"]
    chi2 = F.when(bottom > 0, m["n"] * gap * gap / bottom).when(m["n"] > 0, F.lit(0.0))
    return tables.withColumn("chi2", chi2)


def fisher_exact(tables: DataFrame) -> DataFrame:
    return tables.withColumn("fisher_p", fisher_p("n11", "n10", "n01", "n00"))


def flag_rates(tables: DataFrame) -> DataFrame:
    """Prevalence, rates, difference and relative risk; flags never set drop out.

    Prevalence and base rate are shares of all records; the rates with and
    without the flag are means over the labelled ones. Without the counts over all
    records (`flagged`, `records`, `positives`) the labelled ones are taken for all.
    """
    m = _margins()
    of_cells = {"flagged": m["with_flag"], "records": m["n"], "positives": m["positive"]}
    tables = tables.withColumns({c: v.cast("bigint") for c, v in of_cells.items() if c not in tables.columns})
    rate_with = ratio(m["n11"], m["with_flag"]) * 100.0
    rate_without = ratio(m["n01"], m["without_flag"]) * 100.0
    records = F.col("records").cast("double")
    return (
        tables.where("flagged > 0")
        .withColumns({
            "prevalence_pct": ratio(F.col("flagged").cast("double"), records) * 100.0,
            "base_rate_pct": ratio(F.col("positives").cast("double"), records) * 100.0,
            "rate_without_pct": rate_without,
            "rate_with_pct": rate_with,
        })
        .withColumn("difference_pp", F.col("rate_with_pct") - F.col("rate_without_pct"))
        .withColumn(
            "relative_risk",
            F.when(F.col("rate_without_pct") > 0, F.col("rate_with_pct") / F.col("rate_without_pct"))
            .otherwise(F.lit(float("inf"))),
        )
    )


RATE_COLUMNS = [
    "flag", "flagged", "prevalence_pct", "base_rate_pct", "rate_without_pct",
    "rate_with_pct", "difference_pp", "relative_risk",
]


def flag_prevalence(
    df: DataFrame, flags: list[str] = fixed.FLAGS, label: str = fixed.LABEL
) -> DataFrame:
    """Unrounded prevalence table with the chosen test's p, riskiest flag first."""
    tables = fisher_exact(chi2_yates(expected_cells(_counted(df, flags, label))))
    return (
        flag_rates(tables)
        .withColumn(
            "p_value",
            F.when(F.col("test") == "Fisher", F.col("fisher_p")).otherwise(chi2_1dof_p("chi2")),
        )
        .withColumn("sig", significance_stars(F.col("p_value")))
        .select(*RATE_COLUMNS, "p_value", "sig", "test")
        .orderBy(F.desc("relative_risk"), "flag")
    )


def total_flags(df: DataFrame, flags: list[str] = fixed.FLAGS) -> Column:
    return add_up([F.coalesce(F.col(f), F.lit(0)) for f in flags if f in df.columns]).cast("bigint")


def flag_agreement(
    df: DataFrame, flags: list[str] = fixed.FLAGS, label: str = fixed.LABEL
) -> DataFrame:
    """Records, share, positives and rate by number of flags set."""
    counts = (
        df.select(total_flags(df, flags).alias("total_flags"), F.col(label).alias("_y"))
        .groupBy("total_flags")
        .agg(
            F.count("_y").alias("records"), F.sum("_y").cast("bigint").alias("positives"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    # One row per number of flags: the single window is intended.
    total = F.sum("_rows").over(W.partitionBy(F.lit(0)))
    return counts.select(
        "total_flags", "records",
        (ratio(F.col("records"), total) * 100.0).alias("share_pct"),
        "positives",
        (ratio(F.col("positives"), F.col("records")) * 100.0).alias("rate_pct"),
    )


def with_footer(df: DataFrame, footer: DataFrame) -> DataFrame:
    """The table as text with a summary row below; columns absent there are blank."""
    body = df.select(*[F.col(c).cast("string") for c in df.columns])
    last = footer.select(
        *[
            F.col(c).cast("string").alias(c) if c in footer.columns else F.lit("").alias(c)
            for c in df.columns
        ]
    )
    return body.unionByName(last)


def flag_count_distribution(df: DataFrame, flags: list[str] = fixed.FLAGS) -> DataFrame:
    return df.groupBy(total_flags(df, flags).alias("total_flags")).agg(
        F.count(F.lit(1)).alias("records")
    )


def round_report(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Displayed rounding (ties to even); operators themselves never round."""
    return df.withColumns({c: half_even(F.col(c), d) for c, d in digits.items() if c in df.columns})
