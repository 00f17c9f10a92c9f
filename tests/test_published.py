"""The published figures of the study, rebuilt from small counts."""

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.columns import half_even
from riskloom.functions.pvalues import chi2_1dof_p
from riskloom.operators import agreement, flag_stats, paired, rank_stats, results

RECORDS, POSITIVES = 8781, 556
# flag: (set, rate with %, rate without %, relative risk, p, stars, test)
PREVALENCE = {
    "flag1_sensitive_info": (39, 23.08, 6.26, 3.69, 0.0006, "***", "Fisher"),
    "flag4_anon_employer": (4230, 10.17, 2.77, 3.67, 0.0, "***", "Chi-sq"),
    "flag5_req_role_mismatch": (1935, 12.66, 4.54, 2.79, 0.0, "***", "Chi-sq"),
    "flag2_unrealistic_comp": (806, 14.27, 5.53, 2.58, 0.0, "***", "Chi-sq"),
    "flag3_pressure_tactics": (520, 12.31, 5.96, 2.07, 0.0, "***", "Chi-sq"),
    "flag8_promo_template": (2396, 8.64, 5.47, 1.58, 0.0, "***", "Chi-sq"),
    "flag7_vague_info": (7455, 6.52, 5.28, 1.23, 0.0995, "ns", "Chi-sq"),
    "flag6_info_conflict": (905, 5.52, 6.42, 0.86, 0.3268, "ns", "Chi-sq"),
}
AGREEMENT = {0: (469, 15), 1: (2337, 48), 2: (3095, 184), 3: (1990, 169), 4: (716, 61), 5: (124, 40), 6: (45, 34), 7: (5, 5)}
# flag: (TP, TN, FP, FN, agreement %, kappa)
HUMAN = {
    "flag1_sensitive_info": (6, 42, 2, 0, 96.0, 0.834),
    "flag2_unrealistic_comp": (10, 31, 3, 6, 82.0, 0.565),
    "flag3_pressure_tactics": (7, 42, 1, 0, 98.0, 0.922),
    "flag4_anon_employer": (25, 16, 8, 1, 82.0, 0.635),
    "flag5_req_role_mismatch": (14, 21, 10, 5, 70.0, 0.394),
    "flag6_info_conflict": (3, 38, 7, 2, 82.0, 0.308),
    "flag7_vague_info": (39, 5, 5, 1, 88.0, 0.559),
    "flag8_promo_template": (15, 26, 6, 3, 82.0, 0.623),
}
# True positives among 111 positive test rows, fifty splits, logistic regression.
BASE_HITS = [98, 96, 98, 99, 102, 94, 104, 95, 98, 88, 98, 100, 92, 97, 94, 88, 101, 100, 95, 90, 103, 91, 95, 100, 100, 91, 92, 104, 91, 97, 96, 102, 92, 89, 93, 98, 91, 100, 98, 93, 92, 95, 99, 91, 97, 94, 101, 98, 92, 100]
SINGLE_HITS = [97, 97, 101, 99, 102, 97, 105, 95, 100, 90, 95, 101, 95, 94, 95, 90, 101, 99, 95, 93, 105, 94, 97, 100, 104, 95, 92, 103, 94, 98, 97, 103, 93, 92, 92, 100, 94, 101, 99, 93, 93, 96, 97, 94, 99, 94, 101, 101, 96, 101]


def test_prevalence_and_tests(spark):
    rows = []
    for flag, (n, rate, *_) in PREVALENCE.items():
        hit = round(n * rate / 100)
        rows.append((flag, hit, n - hit, POSITIVES - hit, RECORDS - POSITIVES - n + hit))
    tables = spark.createDataFrame(rows, "flag string, n11 bigint, n10 bigint, n01 bigint, n00 bigint")
    tested = flag_stats.fisher_exact(flag_stats.chi2_yates(flag_stats.expected_cells(tables)))
    out = flag_stats.flag_rates(tested).withColumn(
        "p", F.when(F.col("test") == "Fisher", F.col("fisher_p")).otherwise(chi2_1dof_p("chi2"))
    )
    for r in out.collect():
        n, with_, without, risk, p, _, test = PREVALENCE[r["flag"]]
        assert r["flagged"] == n and r["test"] == test
        assert round(r["rate_with_pct"], 2) == with_
        assert round(r["rate_without_pct"], 2) == without
        assert round(r["relative_risk"], 2) == risk
        assert round(r["p"], 4) == p


def test_flags_per_record_and_spearman(spark):
    rows = [
        (total, int(i < positive))
        for total, (n, positive) in AGREEMENT.items() for i in range(n)
    ]
    df = spark.createDataFrame(rows, "total int, fraudulent_agent int")
    row = rank_stats.spearman(df, F.col("total"), F.col("fraudulent_agent")).first()
    assert row["n"] == RECORDS
    assert round(row["rho"], 4) == 0.1532
    assert round(row["p_value"], 4) == 0.0
    table = flag_stats.flag_agreement(
        df.withColumnRenamed("total", "flag1_sensitive_info"), ["flag1_sensitive_info"]
    )
    assert {r["total_flags"]: (r["records"], r["positives"]) for r in table.collect()} == AGREEMENT


def test_paired_comparison(spark):
    rows = [
        (seed, "lr", grp, "recall", hits / 111)
        for grp, series in (("base", BASE_HITS), ("single_pass", SINGLE_HITS))
        for seed, hits in enumerate(series, start=1)
    ]
    long = spark.createDataFrame(
        rows, "random_state bigint, model string, grp string, metric string, value double"
    )
    tests = paired.compare_groups(long).collect()
    assert len(tests) == 1  # the other groups are missing and their pairs skipped
    r = tests[0]
    assert (r["comparison"], r["n_iters"], r["significant"]) == ("base → single_pass", 50, "Yes")
    assert round(r["mean_a"], 6) == 0.865225 and round(r["mean_b"], 6) == 0.875495
    assert round(r["mean_diff"], 6) == 0.01027
    assert round(r["t_statistic"], 4) == 4.7686 and round(r["p_value"], 4) == 0.0
    assert round(r["cohens_d"], 4) == 0.6744
    assert (round(r["ci_95_lower"], 6), round(r["ci_95_upper"], 6)) == (0.005942, 0.014598)
    means = results.summary_means(long).orderBy("grp").collect()
    assert [round(m["recall"], 6) for m in means] == [0.865225, 0.875495]
    assert means[0]["accuracy"] is None


def test_human_agreement(spark):
    rows = [(f, *cells[:4]) for f, cells in HUMAN.items()]
    counts = spark.createDataFrame(rows, "flag string, tp int, tn int, fp int, fn int")
    out = agreement.cohens_kappa(counts).withColumn("kappa", half_even(F.col("kappa"), 3))
    assert {r["flag"]: r["kappa"] for r in out.collect()} == {f: c[5] for f, c in HUMAN.items()}
    assert sum(c[2] + c[3] for c in HUMAN.values()) == 60


def test_kappa_edges(spark):
    counts = spark.createDataFrame(
        [("empty", 0, 0, 0, 0), ("one side", 9, 0, 0, 0)], "flag string, tp int, tn int, fp int, fn int"
    )
    assert {r["flag"]: r["kappa"] for r in agreement.cohens_kappa(counts).collect()} == {
        "empty": None, "one side": 1.0,
    }


def test_split_sizes_of_the_study():
    from riskloom.operators.splits import class_quotas

    assert class_quotas({0: RECORDS - POSITIVES, 1: POSITIVES}, 0.2) == {0: 1646, 1: 111}


def test_display_names_cover_all_flags():
    assert set(fixed.FLAG_LABELS) == set(fixed.FLAGS) == set(PREVALENCE)


@pytest.mark.parametrize("p, stars", [(0.0005, "***"), (0.009, "**"), (0.04, "*"), (0.05, "ns"), (None, None)])
def test_stars(spark, p, stars):
    from riskloom.functions.columns import significance_stars

    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(significance_stars(F.col("p"))).first()[0] == stars
