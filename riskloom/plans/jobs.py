"""Whole jobs over the operators: each reads a table and gives the tables a
user of the study would want, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import fixed
from riskloom.functions.columns import half_even
from riskloom.operators import agreement, clean, coverage, flag_stats, models, paired, scoring
from riskloom.operators.results import named_models, summary_means
from riskloom.plans import reports
from riskloom.sources import results as result_files
from riskloom.sources.tables import write_table


def score_records(
    df: DataFrame, rules: dict[str, tuple[str, str | None]], weights: dict[str, int],
    label: str = fixed.LABEL,
) -> DataFrame:
    """Flag every record by rules and score it for each agent combination.

    The label is set aside before the rules run, so none can read it.
    """
    hidden = [c for c in (label, fixed.LABEL, fixed.LABEL_ALIAS) if c in df.columns]
    blind = df.drop(*hidden)
    absent = [f for f in fixed.FLAGS if f not in rules]
    scoring.apply_flag_rules(blind, rules)  # fails here if a rule needs the label
    flagged = scoring.apply_flag_rules(df.drop(*absent), rules).withColumns(
        {f: F.lit(0) for f in absent}
    )
    return scoring.weighted_risk(flagged, weights)


def score_by_agents(df: DataFrame, key: str, flag_scorer, subset_scorer) -> DataFrame:
    """(key, flags, combination scores) from injected scorers.

    `flag_scorer(agent, texts)` answers for one agent's flags from the rendered
    record. `subset_scorer(combo, flags)` sees only that combination's flags, as
    JSON, never the record. Failed flag steps leave 0, failed scores null.
    """
    texts = clean.render_posting(clean.strip_sensitive(df, keep_key=key), key)
    agents = {
        agent: ("posting_text", partial(flag_scorer, agent)) for agent in fixed.AGENT_FLAG_IDS
    }
    flagged = scoring.score_many(texts, agents, [key])
    for agent, ids in fixed.AGENT_FLAG_IDS.items():
        names = [fixed.FLAG_BY_ID[i] for i in ids]
        flagged = scoring.parse_flags(flagged, f"response_{agent}", names)
    shown = flagged.withColumns({
        f"seen_{combo}": F.to_json(
            F.struct(*[(F.col(f) == 1).alias(f) for f in scoring.combo_flag_names(combo)])
        )
        for combo in fixed.COMBO_AGENTS
    })
    combos = {c: (f"seen_{c}", partial(subset_scorer, c)) for c in fixed.COMBO_AGENTS}
    answered = scoring.score_many(shown, combos, [key, *fixed.FLAGS])
    for combo, out in fixed.COMBO_SCORE.items():
        answered = scoring.parse_score(answered, out, f"response_{combo}", default=0)
    return answered.select(key, *fixed.FLAGS, *fixed.COMBO_SCORE.values())


def score_selected(
    df: DataFrame, key: str, scorer, start: int = 0, end: int = -1, out: str = fixed.SINGLE_SCORE
) -> DataFrame:
    """Score the records of a position range with an injected scorer and lay
    the scores over the table; rows that fail keep what they had."""
    df = clean.ensure_columns(df, {out: "int"})
    chosen = clean.strip_sensitive(scoring.select_range(df, key, start, end), keep_key=key)
    texts = clean.render_posting(chosen, key)
    answers = scoring.score_with(texts, key, "posting_text", scorer)
    new = scoring.parse_score(answers, out).select(key, "ok", out)
    return scoring.overlay_results(df, new, key, [out], "ok")


def flag_report(df: DataFrame, label: str = fixed.LABEL) -> dict[str, DataFrame]:
    df = clean.coerce_flags(clean.normalize_target(df, label))
    return {
        "flag_prevalence_analysis": reports.prevalence_report(df, label),
        "flag_agreement_analysis": reports.agreement_report(df, label),
        "risk_score_distribution": reports.distribution_report(df, label),
    }


def review_package(
    df: DataFrame, key: str = fixed.KEY, n_total: int = 50, target: int = 6, seed: int = 42
) -> dict[str, DataFrame]:
    """The review sample and its sheets and figures."""
    df = clean.coerce_flags(df)
    sample = coverage.assign_sample_id(
        coverage.coverage_sample(df, key, n_total=n_total, target=target, seed=seed), key
    )
    return {
        "sample_for_review": coverage.review_sheet(sample),
        "ai_flags_reference": coverage.reference_sheet(sample),
        "coverage": coverage.coverage_report(sample, target=target),
        "composition": coverage.sample_composition(sample),
        "flag_counts": flag_stats.flag_count_distribution(sample),
    }


def _done(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def evaluation_run(
    df: DataFrame, key: str, label: str, folder: str, start: int = 1, count: int = 50,
    learners: Iterable[str] = tuple(models.MODELS), groups: dict[str, list[str]] = fixed.FEATURE_GROUPS,
    **options,
) -> DataFrame:
    """The whole evaluation: fit the grid, then write one wide table per model and the
    summary of means to `folder`. Returns the summary.

    Results are appended seed by seed below `folder`/progress, so a repeated run
    fits only what is missing (by seed, model and group).
    """
    spark, progress = df.sparkSession, f"{folder}/progress"
    usable = models.group_columns(df, groups)
    for seed in range(start, start + count):
        done = _done(spark, progress)
        have = set()
        if done is not None:
            # At most models x groups rows of one seed.
            rows = done.where(F.col("random_state") == seed).select("model", "grp").distinct().collect()
            have = {(r["model"], r["grp"]) for r in rows}
        todo = {}
        for group, columns in usable.items():
            missing = tuple(m for m in learners if (m, group) not in have)
            if missing:
                todo.setdefault(missing, {})[group] = columns
        for names, wanted in todo.items():
            found = models.evaluate_grid(df, key, label, [seed], names, wanted, **options)
            found.coalesce(1).write.mode("append").parquet(progress)
    run = f"rs{start}-{start + count - 1}"
    long = spark.read.parquet(progress).where(F.col("random_state").between(start, start + count - 1))
    result_files.write_results(long, folder, run)
    means = named_models(summary_means(long)).withColumnRenamed("grp", "group")
    shown = means.withColumns({m: half_even(F.col(m), 6) for m in fixed.METRICS}).orderBy("model", "group")
    write_table(shown.coalesce(1), f"{folder}/summary_means_{run}.csv", "csv")
    return shown


def comparison_run(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """Compare the feature groups of a run's result files and write the table beside
    them. Without `run` there must be exactly one in the folder."""
    if run is None:
        found = result_files.discover_result_sets(spark, folder)
        if len(found) != 1:
            raise ValueError(f"name one of the runs in {folder}: {found}")
        run = found[0]
    long = result_files.load_results(spark, folder, run)
    table = reports.comparison_report(long)
    write_table(table.coalesce(1), f"{folder}/statistical_comparisons_{run}.csv", "csv")
    tests = paired.compare_groups(long)
    return {
        "comparisons": table,
        "significance_counts": paired.significance_counts(tests),
        "model_significance": paired.model_significance(tests),
    }


def agreement_run(review: DataFrame, reference: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Human against machine flags of a review sheet: figures, disagreements and
    their counts, written to `folder`."""
    matched = agreement.match_labels(review, reference)
    ids = [c for c in ("sample_id", fixed.KEY) if c in matched.columns]
    differing = agreement.disagreements(matched, ids)
    tables = {
        "manual_vs_ai_comparison": reports.human_report(review, reference),
        "manual_vs_ai_disagreements": agreement.sorted_disagreements(differing),
        "disagreement_counts": agreement.disagreement_counts(differing),
    }
    for name, table in tables.items():
        write_table(table.coalesce(1), f"{folder}/{name}.csv", "csv")
    return tables
