"""The displayed tables: rounded, ordered and under their published headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom import fixed
from riskloom.functions.columns import significance_stars
from riskloom.operators import agreement, flag_stats, paired, rank_stats
from riskloom.operators.flag_stats import round_report
from riskloom.operators.results import named_models

# Report headings and their display digits (None = as it is).
PREVALENCE = [
    ("Flag", "flag_name", None), ("Column", "flag", None), ("Flagged (n)", "flagged", None),
    ("Prevalence (%)", "prevalence_pct", 2), ("Base Fraud Rate (%)", "base_rate_pct", 2),
    ("Fraud Rate Without (%)", "rate_without_pct", 2), ("Fraud Rate With (%)", "rate_with_pct", 2),
    ("Difference (pp)", "difference_pp", 2), ("Relative Risk", "relative_risk", 2),
    ("p-value", "p_value", 4), ("Sig", "sig", None), ("Test", "test", None),
]
AGREEMENT = [
    ("Number of Flags Fired", "total_flags", None), ("Total Postings", "records", None),
    ("Percentage of Postings (%)", "share_pct", 2), ("Fraudulent Postings", "positives", None),
    ("Fraud Rate (%)", "rate_pct", 2),
]
DISTRIBUTION = [
    ("Column", "score", None), ("N (total)", "n_total", None), ("N (legit)", "n_neg", None),
    ("N (fraud)", "n_pos", None), ("Mean (legit)", "mean_neg", 3), ("Mean (fraud)", "mean_pos", 3),
    ("Median (legit)", "median_neg", 1), ("Median (fraud)", "median_pos", 1),
    ("Std (legit)", "std_neg", 3), ("Std (fraud)", "std_pos", 3),
    ("Mann-Whitney p", "p_value", 4), ("Sig", "sig", None), ("AUROC", "auroc", 4),
]
COMPARISON = [
    ("model", "model", None), ("comparison", "comparison", None), ("group_A", "group_a", None),
    ("group_B", "group_b", None), ("metric", "metric", None), ("n_iters", "n_iters", None),
    ("mean_A", "mean_a", 6), ("mean_B", "mean_b", 6), ("mean_diff", "mean_diff", 6),
    ("t_statistic", "t_statistic", 4), ("p_value", "p_value", 4), ("cohens_d", "cohens_d", 4),
    ("ci_95_lower", "ci_95_lower", 6), ("ci_95_upper", "ci_95_upper", 6),
    ("significant", "significant", None),
]
HUMAN = [
    ("Flag", "flag_name", None), ("AI Column", "flag", None), ("N Compared", "n_compared", None),
    ("AI Positive", "ai_positive", None), ("Human Positive", "human_positive", None),
    ("True Positive", "tp", None), ("True Negative", "tn", None), ("False Positive", "fp", None),
    ("False Negative", "fn", None), ("Agreement (%)", "agreement_pct", 1), ("Cohens Kappa", "kappa", 3),
]


def _shown(df: DataFrame, headings) -> DataFrame:
    rounded = round_report(df, {name: d for _, name, d in headings if d is not None})
    return rounded.select(*[F.col(name).alias(title) for title, name, _ in headings])


def _named(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in fixed.FLAG_LABELS.items() for x in pair])
    return df.withColumn("flag_name", F.coalesce(F.try_element_at(names, F.col("flag")), F.col("flag")))


def prevalence_report(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    shown = _shown(_named(flag_stats.flag_prevalence(df, label=label)), PREVALENCE)
    return shown.orderBy(F.desc("Relative Risk"), "Column")


def agreement_report(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    """Flags per record with the rank correlation as footer."""
    table = _shown(flag_stats.flag_agreement(df, label=label), AGREEMENT).orderBy("Number of Flags Fired")
    rho = rank_stats.spearman(df, flag_stats.total_flags(df), F.col(label))
    footer = rho.select(
        F.lit("Spearman ρ").alias("Number of Flags Fired"),
        F.bround("rho", 4).alias("Fraudulent Postings"),
        F.bround("p_value", 4).alias("Fraud Rate (%)"),
    )
    return flag_stats.with_footer(table, footer)


def distribution_report(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    table = rank_stats.score_distribution(df, label=label).withColumns({
        "n_total": F.col("n_neg") + F.col("n_pos"),
        "sig": significance_stars(F.col("p_value")),
    })
    return _shown(table, DISTRIBUTION)


def comparison_report(long: DataFrame) -> DataFrame:
    return _shown(named_models(paired.compare_groups(long)), COMPARISON)


def human_report(review: DataFrame, reference: DataFrame) -> DataFrame:
    matched = agreement.match_labels(review, reference)
    return _shown(_named(agreement.confusion_by_flag(matched)), HUMAN)
