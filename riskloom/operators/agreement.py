"""Agreement between human and machine flags on a reviewed sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import fixed
from riskloom.functions.columns import ratio, with_numbers


def _numbered(review: DataFrame, key: str) -> DataFrame:
    """The review with its id as a whole number, null where it is none."""
    number = F.col("_number")
    return (
        with_numbers(review, {"_number": key})
        .withColumn(key, F.when(number == F.floor(number), number).try_cast("bigint"))
        .drop("_number")
    )


def valid_sample_rows(review: DataFrame, reference: DataFrame, key: str = "sample_id") -> DataFrame:
    """Review rows whose numeric id is in the reference; drops totals rows."""
    ids = reference.select(F.col(key).cast("bigint").alias(key))
    return _numbered(review, key).join(ids, key, "left_semi")


def match_labels(
    review: DataFrame, reference: DataFrame, key: str = "sample_id",
    flags: list[str] = fixed.FLAGS, prefix: str = "manual_",
) -> DataFrame:
    """Reference rows with the human flags of the same sample beside them.

    The inner join by itself leaves out review rows that are no sample rows.
    """
    human = [prefix + f for f in flags if prefix + f in review.columns]
    rows = _numbered(review, key).select(key, *human)
    return reference.withColumn(key, F.col(key).cast("bigint")).join(rows, key)


def _compared(matched: DataFrame, flags, prefix) -> list[str]:
    return [f for f in flags if f in matched.columns and prefix + f in matched.columns]


def _read(matched: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """Both sides' flags as numbers, parsed once."""
    return with_numbers(
        matched, {**{f: f for f in names}, **{prefix + f: prefix + f for f in names}}
    )


def _sides(flag: str, prefix: str) -> tuple[Column, Column, Column]:
    """(machine flag, human flag, both usable)."""
    ai, human = F.col(flag), F.col(prefix + flag)
    return ai, human, ai.isin(0.0, 1.0) & human.isin(0.0, 1.0)


def confusion_by_flag(
    matched: DataFrame, flags: list[str] = fixed.FLAGS, prefix: str = "manual_"
) -> DataFrame:
    """Per flag the counts, agreement % and Cohen's kappa; one pass, no join."""
    names = _compared(matched, flags, prefix)
    sums, rows = [], []
    for f in names:
        ai, human, ok = _sides(f, prefix)
        for name, a, h in (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1)):
            sums.append(F.count(F.when(ok & (ai == a) & (human == h), 1)).alias(f"{f}__{name}"))
        rows.append(
            F.struct(
                F.lit(f).alias("flag"),
                *[F.col(f"{f}__{n}").alias(n) for n in ("tp", "tn", "fp", "fn")],
            )
        )
    counts = _read(matched, names, prefix).agg(*sums).select(F.inline(F.array(*rows)))
    return cohens_kappa(
        counts.withColumns({
            "n_compared": F.expr("tp + tn + fp + fn"),
            "ai_positive": F.expr("tp + fp"),
            "human_positive": F.expr("tp + fn"),
        }).withColumn(
            "agreement_pct", ratio(F.expr("tp + tn"), F.col("n_compared")) * 100.0
        )
    )


def cohens_kappa(counts: DataFrame) -> DataFrame:
    """Add kappa: 1 when chance agreement is complete, null without rows."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    observed = F.try_divide(tp + tn, n)
    chance = (
        F.try_divide(tp + fp, n) * F.try_divide(tp + fn, n)
        + F.try_divide(tn + fn, n) * F.try_divide(tn + fp, n)
    )
    return counts.withColumn(
        "kappa",
        F.when(n == 0, None).when(chance == 1.0, 1.0)
        .otherwise(F.try_divide(observed - chance, 1.0 - chance)),
    )


def disagreements(
    matched: DataFrame, ids: list[str], flags: list[str] = fixed.FLAGS, prefix: str = "manual_"
) -> DataFrame:
    """One row per sample and flag on which the two sides differ."""
    names, rows = _compared(matched, flags, prefix), []
    for f in names:
        ai, human, ok = _sides(f, prefix)
        rows.append(
            F.struct(
                F.lit(fixed.FLAG_LABELS.get(f, f)).alias("flag"),
                ai.cast("int").alias("ai_label"),
                human.cast("int").alias("human_label"),
                (ok & (ai != human)).alias("_differs"),
            )
        )
    return (
        _read(matched, names, prefix)
        .select(*ids, F.inline(F.array(*rows)))
        .where("_differs").drop("_differs")
        .withColumn(
            "type",
            F.when(F.col("ai_label") == 1, fixed.FALSE_POSITIVE).otherwise(fixed.FALSE_NEGATIVE),
        )
    )


def sorted_disagreements(table: DataFrame, key: str = "sample_id") -> DataFrame:
    return table.orderBy("flag", key)


def disagreement_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("type").agg(F.count(F.lit(1)).alias("records"))
