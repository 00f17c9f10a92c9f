"""A small review sample that covers every flag, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom import fixed
from riskloom.functions.columns import add_up, draw_hash, ratio


def flag_rarity(df: DataFrame, flags: list[str] = fixed.FLAGS) -> DataFrame:
    """Positives per flag."""
    present = [f for f in flags if f in df.columns]
    sums = df.agg(*[F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in present])
    return sums.unpivot([], present, "flag", "positives")


def greedy_keys(
    df: DataFrame, key: str, flags: list[str] = fixed.FLAGS, n_total: int = 50, target: int = 6
) -> list:
    """Keys of the coverage sample, at most `n_total`.

    Flags are taken from the rarest up; each adds the records still missing
    for its target, best first (most still-needed flags, then key). A round is
    one distributed top-k whose size is at most the budget, and only those few
    rows reach the driver.
    """
    present = [f for f in flags if f in df.columns]
    counts = {r["flag"]: r["positives"] for r in flag_rarity(df, present).collect()}
    order = sorted(present, key=lambda f: (counts[f], present.index(f)))
    narrow = df.select(key, *present)
    chosen: list = []
    covered = dict.fromkeys(present, 0)
    for flag in order:
        need = min(target - covered[flag], n_total - len(chosen))
        if need <= 0:
            continue
        wanted = [f for f in present if covered[f] < target]
        score = add_up([F.coalesce(F.col(f), F.lit(0)) for f in wanted])
        candidates = narrow.where(F.col(flag) == 1)
        if chosen:
            candidates = candidates.where(~F.col(key).isin(chosen))
        for row in candidates.orderBy(score.desc(), F.col(key)).limit(need).collect():
            chosen.append(row[key])
            for f in present:
                covered[f] += int(row[f] == 1)
    return chosen


def greedy_coverage(
    df: DataFrame, key: str, flags: list[str] = fixed.FLAGS, n_total: int = 50, target: int = 6
) -> DataFrame:
    chosen = greedy_keys(df, key, flags, n_total, target)
    return df.where(F.col(key).isin(chosen))


def fill_stratified(
    df: DataFrame,
    key: str,
    chosen: list,
    n_total: int = 50,
    label: str | None = fixed.LABEL,
    seed: int = 42,
) -> DataFrame:
    """The chosen records plus a random fill up to `n_total`: half positives
    as far as they last, the rest negatives, then whatever is left."""
    remaining = n_total - len(chosen)
    if remaining <= 0:
        return df.where(F.col(key).isin(chosen))
    columns = [key] + ([label] if label in df.columns else [])
    pool = df.select(*columns).where(~F.col(key).isin(chosen)) if chosen else df.select(*columns)
    drawn = pool.withColumn("_draw", draw_hash(F.col(key), seed))

    def draw(rows: DataFrame, k: int) -> list:  # k is at most n_total
        return [r[key] for r in rows.orderBy("_draw", key).limit(k).collect()] if k else []

    if label not in df.columns:
        fill = draw(drawn, remaining)
    else:
        positives = draw(drawn.where(F.col(label) == 1), remaining // 2)
        negatives = draw(drawn.where(F.col(label) == 0), remaining - len(positives))
        fill = positives + negatives
        short = remaining - len(fill)
        if short:
            fill += draw(drawn.where(~F.col(key).isin(fill)) if fill else drawn, short)
    return df.where(F.col(key).isin(chosen + fill))


def coverage_sample(
    df: DataFrame, key: str, flags: list[str] = fixed.FLAGS, n_total: int = 50,
    target: int = 6, label: str | None = fixed.LABEL, seed: int = 42,
) -> DataFrame:
    chosen = greedy_keys(df, key, flags, n_total, target)
    return fill_stratified(df, key, chosen, n_total, label, seed)


def assign_sample_id(sample: DataFrame, key: str) -> DataFrame:
    """Number the sample 1..n in key order. The sample has at most a few dozen
    rows, so the single window is intended."""
    return sample.withColumn("sample_id", F.row_number().over(W.orderBy(key)))


def review_sheet(sample: DataFrame) -> DataFrame:
    """What the reviewer gets: the record and blank flags, no label or flags."""
    shown = [c for c in fixed.REVIEW_COLUMNS if c in sample.columns]
    return sample.select(*shown, *[F.lit("").alias(c) for c in fixed.MANUAL_FLAGS])


def reference_sheet(sample: DataFrame) -> DataFrame:
    return sample.select(*[c for c in fixed.REFERENCE_COLUMNS if c in sample.columns])


def coverage_report(
    sample: DataFrame, flags: list[str] = fixed.FLAGS, target: int = 6
) -> DataFrame:
    """Per flag: positives, share of the sample, and whether the target is met."""
    total = sample.agg(F.count(F.lit(1))).scalar()
    short = F.lit(target) - F.col("positives")
    return flag_rarity(sample, flags).select(
        "flag", "positives",
        (ratio(F.col("positives"), total) * 100.0).alias("share_pct"),
        F.when(short <= 0, "OK")
        .otherwise(F.concat(F.lit("short by "), short.cast("string"))).alias("status"),
    )


def sample_composition(sample: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    """Positives and negatives with their shares."""
    sums = sample.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("p")
    )
    rows = F.array(
        F.struct(F.lit("positive").alias("part"), F.col("p").alias("records"), F.col("n")),
        F.struct(F.lit("negative").alias("part"), (F.col("n") - F.col("p")).alias("records"), F.col("n")),
    )
    return sums.select(F.inline(rows)).select(
        "part", "records", (ratio(F.col("records"), F.col("n")) * 100.0).alias("share_pct")
    )
