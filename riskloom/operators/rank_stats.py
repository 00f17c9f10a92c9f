"""Rank statistics, exact at any size.

Everything starts from one row per distinct value (map-side combined), never
from a window over the records. The order of the values is cut into ranges
first; on a short scale (0..10 scores, counts of flags) these are a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom import fixed
from riskloom.functions.columns import ratio, score_0_10, with_numbers
from riskloom.functions.pvalues import normal_upper_p, student_two_sided_p
from riskloom.operators.ordering import running_totals, split_points


def long_scores(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """(score, value, label) rows of the readable scores."""
    present = [s for s in scores if s in df.columns]
    numbers = with_numbers(df.select(label, *present), {s: s for s in present})
    pairs = F.array(
        *[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in present]
    )
    return numbers.select(F.inline(pairs), F.col(label).cast("int").alias("label")).where(
        F.col("value").isNotNull()
    )


def class_counts(
    df: DataFrame, scores: list[str] = fixed.SCORES, label: str = fixed.LABEL
) -> DataFrame:
    """One row per (score, value): records of each class. Null labels drop out."""
    long = long_scores(df, scores, label)
    return long.groupBy("score", "value").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == 0, 1)).alias("neg"),
    )


def _points(counts: DataFrame, column: str, continuous: bool) -> list:
    return split_points(counts, column) if continuous else []


def rank_sums(
    df: DataFrame,
    scores: list[str] = fixed.SCORES,
    label: str = fixed.LABEL,
    continuous: bool = True,
) -> DataFrame:
    """Per score: class sizes, U of the positives (ties count half), tie term."""
    return _rank_sums(class_counts(df, scores, label), continuous)


def _rank_sums(counts: DataFrame, continuous: bool) -> DataFrame:
    ranked = running_totals(
        counts, "value", ["neg"], ["score"], _points(counts, "value", continuous)
    )
    pos, neg, below = (F.col(c).cast("double") for c in ("pos", "neg", "neg_before"))
    tied = pos + neg
    return (
        ranked.groupBy("score")
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            F.sum(pos * (below + neg / 2.0)).alias("u"),
            F.sum(tied * tied * tied - tied).alias("tie_term"),
        )
        .where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    )


def auroc(df, scores=fixed.SCORES, label=fixed.LABEL, continuous=True) -> DataFrame:
    """Exact area under the ROC curve; scores lacking a class are left out."""
    sums = rank_sums(df, scores, label, continuous)
    return sums.select(
        "score", "n_pos", "n_neg",
        (F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auroc"),
    )


def mann_whitney(df, scores=fixed.SCORES, label=fixed.LABEL, continuous=True) -> DataFrame:
    """One-sided test (positives higher): U, z with tie and continuity
    correction, and the normal p."""
    tests = _normal_test(rank_sums(df, scores, label, continuous))
    return tests.select("score", "n_pos", "n_neg", "u", "z", "p_value")


def _normal_test(sums: DataFrame) -> DataFrame:
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1.0) - F.try_divide(F.col("tie_term"), n * (n - 1.0))))
    return sums.withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2.0 - 0.5, spread)).withColumn(
        "p_value", normal_upper_p("z")
    )


def spearman(df: DataFrame, x: Column, y: Column, continuous: bool = True) -> DataFrame:
    """One row: n, rho over average ranks, and the two-sided t p-value."""
    pairs = (
        df.select(x.alias("x"), y.alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    )

    def ranks(side: str) -> DataFrame:
        values = pairs.groupBy(side).agg(F.sum("n").alias("m"))
        placed = running_totals(values, side, ["m"], points=_points(values, side, continuous))
        return placed.select(
            F.col(side).alias(f"_{side}"),
            (2.0 * F.col("m_before") + F.col("m") + 1.0).alias(f"rank_{side}"),
        )

    total = pairs.agg(F.sum("n")).scalar().cast("double")
    weight = F.col("n").cast("double")
    ranked = (
        pairs.join(ranks("x"), F.col("x") == F.col("_x"))
        .join(ranks("y"), F.col("y") == F.col("_y"))
        .withColumns({  # twice the rank, centred: its mean is total + 1
            "a": F.col("rank_x") - (total + 1.0),
            "b": F.col("rank_y") - (total + 1.0),
        })
    )
    sums = ranked.agg(
        F.sum("n").alias("n"),
        F.sum(weight * F.col("a") * F.col("b")).alias("ab"),
        F.sum(weight * F.col("a") * F.col("a")).alias("aa"),
        F.sum(weight * F.col("b") * F.col("b")).alias("bb"),
    )
    rho = F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")))
    dof = (F.col("n") - 2).cast("double")
    return (
        sums.withColumn("rho", rho)
        .withColumn("t", F.col("rho") * F.sqrt(F.try_divide(dof, (1.0 - F.col("rho")) * (1.0 + F.col("rho")))))
        .withColumn(
            "p_value",
            F.when(F.abs(F.col("rho")) >= 1.0, F.lit(0.0)).otherwise(student_two_sided_p("t", dof)),
        )
        .select("n", "rho", "p_value")
    )


def exact_medians(
    counts: DataFrame, value: str, n: str, groups: list[str], points: list | None = None
) -> DataFrame:
    """Exact median per group from (group, value, count) rows."""
    placed = running_totals(counts, value, [n], groups, points)
    sizes = counts.groupBy(*groups).agg(F.sum(n).alias("_size"))
    # One row per group: broadcast is bounded by the number of columns measured.
    sized = placed.join(F.broadcast(sizes), groups)
    first, last = F.col(f"{n}_before"), F.col(f"{n}_before") + F.col(n)
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)

    def at(position):
        return F.max(F.when((first <= position) & (position < last), F.col(value)))

    return sized.groupBy(*groups).agg(((at(low) + at(high)) / 2.0).alias("median"))


def score_distribution(
    df: DataFrame,
    scores: list[str] = fixed.SCORES,
    label: str = fixed.LABEL,
    continuous: bool = True,
) -> DataFrame:
    """Per score: size, mean, exact median and sample deviation of each class,
    with the Mann-Whitney p and the AUROC."""
    classes = class_counts(df, scores, label)  # the one pass over the records
    counts = classes.select(
        "score", "value",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("label"), F.col("neg").alias("n")),
                F.struct(F.lit(1).alias("label"), F.col("pos").alias("n")),
            )
        ),
    ).where("n > 0")
    keys, weight = ["score", "label"], F.col("n").cast("double")
    medians = exact_medians(counts, "value", "n", keys, _points(classes, "value", continuous))
    means = counts.groupBy(*keys).agg(
        F.sum("n").alias("size"), (F.sum(weight * F.col("value")) / F.sum(weight)).alias("mean")
    )
    # Two rows per score: the broadcast is bounded.
    gap = F.col("value") - F.col("mean")
    moments = (
        counts.join(F.broadcast(means), keys)
        .groupBy(*keys, "size", "mean")
        .agg(F.sum(weight * gap * gap).alias("_squares"))
        .withColumn("std", F.sqrt(F.try_divide("_squares", F.col("size") - 1.0)))
    )
    both = moments.withColumnRenamed("size", "n").join(medians, keys)

    def of(name, cls):
        return F.max(F.when(F.col("label") == cls, F.col(name))).alias(f"{name}_{'pos' if cls else 'neg'}")

    sides = both.groupBy("score").agg(
        *[of(name, cls) for name in ("n", "mean", "median", "std") for cls in (0, 1)]
    )
    tests = _normal_test(_rank_sums(classes, continuous))
    area = F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return sides.where("n_pos > 0 and n_neg > 0").join(
        tests.select("score", "p_value", area.alias("auroc")), "score"
    )


def score_histograms(
    df: DataFrame, scores: list[str], label: str = fixed.LABEL
) -> DataFrame:
    """(score, bucket, records, rate_pct) for all of 0..10, every score in one
    pass. Scores are rounded half to even and limited to the scale; the rate of
    an empty bucket is null."""
    counts = (
        long_scores(df, scores, label)
        .groupBy("score", score_0_10(F.col("value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("records"), F.avg(F.col("label").cast("double")).alias("_rate"))
    )
    scale = df.sparkSession.range(11).select(
        F.explode(F.array(*[F.lit(s) for s in scores])).alias("score"),
        F.col("id").cast("int").alias("bucket"),
    )
    # At most 11 rows per score: the broadcast is bounded.
    return scale.join(F.broadcast(counts), ["score", "bucket"], "left").select(
        "score", "bucket",
        F.coalesce(F.col("records"), F.lit(0)).cast("bigint").alias("records"),
        (F.col("_rate") * 100.0).alias("rate_pct"),
    )


def score_histogram(df: DataFrame, score: str, label: str = fixed.LABEL) -> DataFrame:
    return score_histograms(df, [score], label).drop("score")


def score_histogram_pair(
    df: DataFrame, scores: list[str], label: str = fixed.LABEL
) -> DataFrame:
    """Histograms of several scores with the shared axis limit
    (1.08 x the largest bucket)."""
    # Eleven rows per score: the single window is intended.
    top = F.max("records").over(W.partitionBy(F.lit(0))).cast("double")
    return score_histograms(df, scores, label).withColumn("axis_max", top * 1.08)


def average_precision(
    df: DataFrame, score: str, label: str, groups: list[str] = (), continuous: bool = True
) -> DataFrame:
    """Step-wise area under precision-recall, ties grouped, per group."""
    groups = list(groups)
    counts = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("hits"), F.count(F.lit(1)).alias("seen")
    )
    ranked = running_totals(
        counts, score, ["hits", "seen"], groups, _points(counts, score, continuous), descending=True
    )
    precision = ratio(F.col("hits_before") + F.col("hits"), F.col("seen_before") + F.col("seen"))
    return ranked.groupBy(*groups).agg(
        F.sum("hits").alias("positives"),
        F.coalesce(
            F.try_divide(
                F.sum(F.col("hits").cast("double") * precision), F.sum("hits").cast("double")
            ),
            F.lit(0.0),
        ).alias("average_precision"),
    )


def classification_metrics(
    df: DataFrame, label: str, prediction: str, groups: list[str] = ()
) -> DataFrame:
    """Accuracy, recall and F1 (0 where undefined) per group."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(y & p, 1)).alias("tp"),
        F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(y & ~p, 1)).alias("fn"),
        F.count(F.when(~y & ~p, 1)).alias("tn"),
    )
    zero = F.lit(0.0)
    return counts.select(
        *groups, "n", "tp", "fp", "fn", "tn",
        ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(
            ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero
        ).alias("f1"),
    )
