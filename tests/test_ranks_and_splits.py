import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions import pvalues
from riskloom.functions.lineage import cut
from riskloom.operators import flag_stats, ordering, rank_stats, splits


def test_split_points_and_positions_match_a_sort(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SAMPLE_PER_RANGE", 2)
    keys = spark.range(0, 3000, 3).select((F.col("id") * 7919 % 3001).alias("k")).distinct()
    points = ordering.split_points(keys, "k", ranges=16)
    assert 4 <= len(points) <= 40
    placed = ordering.row_positions(keys, "k", points).orderBy("k").collect()
    assert [r["position"] for r in placed] == list(range(len(placed)))
    text = keys.select(F.concat(F.lit("id-"), F.col("k").cast("string")).alias("k"))
    placed = ordering.row_positions(text, "k", ordering.split_points(text, "k", ranges=16)).collect()
    assert [r["k"] for r in sorted(placed, key=lambda r: r["position"])] == sorted(r["k"] for r in placed)


def test_keys_at(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SAMPLE_PER_RANGE", 1)
    df = spark.range(100, 1100).withColumnRenamed("id", "k")
    assert ordering.keys_at(df, "k", [0, 499, 999, 1000]) == [100, 599, 1099, None]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_across_ranges(spark, descending):
    rows = [(g, v, v % 5 + 1) for g in ("a", "b") for v in range(0, 200, 1 + (g == "b"))]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    plain = ordering.running_totals(df, "v", ["n"], ["g"], descending=descending)
    ranged = ordering.running_totals(df, "v", ["n"], ["g"], [3, 50, 51, 199], descending)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "s double, y int")


def test_auroc_is_u_over_pairs_and_ties_count_half(spark):
    df = scores(spark, [(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1), (None, 1), (2.0, None)])
    row = rank_stats.auroc(df, ["s"], "y").first()
    assert (row["n_pos"], row["n_neg"], row["auroc"]) == (2, 2, 3.5 / 4)
    only_ties = scores(spark, [(5.0, 0), (5.0, 1)])
    assert rank_stats.auroc(only_ties, ["s"], "y").first()["auroc"] == 0.5
    tied = rank_stats.mann_whitney(only_ties, ["s"], "y").first()
    assert tied["z"] is None and tied["p_value"] is None


def test_scores_without_both_classes_are_left_out(spark):
    df = spark.createDataFrame([(1, 2.0, None), (0, None, None)], "y int, s double, t double")
    assert rank_stats.score_distribution(df, ["s", "t", "absent"], "y").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=30))
def test_rank_statistics_against_brute_force(spark, pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    df = scores(spark, [(float(s), y) for s, y in pairs])
    rows = rank_stats.auroc(df, ["s"], "y", continuous=True).collect()
    if not pos or not neg:
        assert rows == []
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert rows[0]["auroc"] == pytest.approx(wins / len(pos) / len(neg))
    stats = rank_stats.score_distribution(df, ["s"], "y").first()
    assert stats["median_pos"] == np.median(pos) and stats["median_neg"] == np.median(neg)
    precision = 0.0
    for t in set(pos):
        hits = sum(p >= t for p in pos)
        precision += sum(p == t for p in pos) / len(pos) * hits / (hits + sum(n >= t for n in neg))
    assert rank_stats.average_precision(df, "s", "y").first()["average_precision"] == pytest.approx(precision)


def test_spearman_edges(spark):
    df = spark.createDataFrame([(1, 2), (2, 4), (3, 6)], "x int, y int")
    row = rank_stats.spearman(df, F.col("x"), F.col("y")).first()
    assert row["rho"] == pytest.approx(1.0) and row["p_value"] == pytest.approx(0.0, abs=1e-6)
    flat = spark.createDataFrame([(1, 2), (1, 4)], "x int, y int")
    assert rank_stats.spearman(flat, F.col("x"), F.col("y")).first()["rho"] is None


def test_histogram_has_all_buckets(spark):
    df = scores(spark, [(2.5, 1), (1.5, 0), (40.0, 1), (-3.0, 0), (None, 1)])
    out = {r["bucket"]: (r["records"], r["rate_pct"]) for r in rank_stats.score_histogram(df, "s", "y").collect()}
    assert len(out) == 11
    assert out[2] == (2, 50.0) and out[10] == (1, 100.0) and out[0] == (1, 0.0) and out[5] == (0, None)


def test_metrics_with_nothing_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    row = rank_stats.classification_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0)
    none = scores(spark, [(1.0, 0)])
    assert rank_stats.average_precision(none, "s", "y").first()["average_precision"] == 0.0


def test_infinite_relative_risk_and_unset_flags(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (0, 0, 0)], "a int, b int, y int")
    rows = flag_stats.flag_prevalence(df, ["a", "b", "absent"], "y").collect()
    assert [r["flag"] for r in rows] == ["a"]
    assert math.isinf(rows[0]["relative_risk"]) and rows[0]["test"] == "Fisher"
    always = spark.createDataFrame([(1, 1), (1, 0)] * 10, "a int, y int")
    row = flag_stats.flag_prevalence(always, ["a"], "y").first()
    assert math.isinf(row["relative_risk"]) and (row["test"], row["p_value"]) == ("Chi-sq", 1.0)


def test_unlabelled_records_are_no_negatives(spark):
    rows = [(1, 1), (1, 0), (1, None), (0, 0), (0, 1), (0, 0), (0, None), (None, None)]
    df = spark.createDataFrame(rows, "a int, y int")
    cells = flag_stats.contingency(df, ["a"], "y").first()
    assert (cells["n11"], cells["n10"], cells["n01"], cells["n00"]) == (1, 1, 1, 2)
    row = flag_stats.flag_prevalence(df, ["a"], "y").first()
    assert row["flagged"] == 3 and row["prevalence_pct"] == 37.5 and row["base_rate_pct"] == 25.0
    assert row["rate_with_pct"] == 50.0 and row["rate_without_pct"] == pytest.approx(100 / 3)


def test_p_values():
    assert pvalues.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-9)
    assert pvalues.t_quantile_975(49) == pytest.approx(2.0095752371, rel=1e-9)
    assert pvalues.t_quantile_975(1) == pytest.approx(12.706204736174694, rel=1e-9)
    # a lady tasting tea
    assert pvalues.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert pvalues.fisher_two_sided(0, 0, 5, 9) == 1.0
    big = pvalues.fisher_two_sided(3, 10**9, 4 * 10**6, 10**15)
    assert 0.0 <= big <= 1.0


def test_quotas():
    assert splits.class_quotas({0: 7, 1: 4}, 0.2) == {0: 2, 1: 1}
    assert splits.class_quotas({0: 5, 1: 5}, 0.5) == {0: 3, 1: 2}


@pytest.mark.parametrize("prefix", [1, 4])
def test_split_is_the_sorted_prefix(spark, monkeypatch, prefix):
    monkeypatch.setattr(splits, "PREFIX", prefix)
    import hashlib

    df = spark.range(500).select("id", (F.col("id") % 9 == 0).cast("int").alias("y"))
    out = splits.stratified_split(df, "id", "y", 0.2, seed=5).collect()
    test = {r["id"] for r in out if r["is_test"]}
    expected = set()
    quotas = splits.class_quotas({0: 444, 1: 56}, 0.2)
    for c in (0, 1):
        keys = sorted(
            (r["id"] for r in out if r["y"] == c),
            key=lambda k: hashlib.md5(f"{k}:5".encode()).hexdigest(),
        )
        expected |= set(keys[: quotas[c]])
    assert test == expected and len(test) == 100


def test_class_too_small_for_the_test_part(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(21)], "id int, y int")
    out = splits.stratified_split(df, "id", "y", 0.2, seed=1).collect()
    assert sum(r["is_test"] for r in out) == 5 and len(out) == 21


def test_splits_of_a_run_equal_single_splits(spark):
    df = spark.range(200).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    run = splits.monte_carlo_splits(df, "id", "y", start=3, count=2)
    for seed in (3, 4):
        one = splits.stratified_split(df, "id", "y", 0.2, seed)
        many = run.where(F.col("seed") == seed).select("id", "y", "is_test")
        assert one.exceptAll(many).count() == 0 and many.count() == 200


def test_plans_have_no_single_task_sort_of_the_records(spark, data):
    """The split's plan windows only the few records around the cut."""
    orders = spark.read.parquet(f"{data}/orders.parquet").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias(fixed.LABEL)
    )
    cuts = cut(splits.split_cuts(orders, "o_orderkey", fixed.LABEL, [1]))
    marked = splits.with_split(orders, "o_orderkey", fixed.LABEL, cuts, 1)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan
    assert "BroadcastHashJoin" in plan


def test_a_split_lists_only_a_band_of_records(spark, monkeypatch):
    """The rows counted grow as the square root of the records; a cut outside its band is found too."""
    df = spark.range(20_000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    narrow = df.select(F.col("id").alias("cut_key"), F.col("y").alias("label"))
    sizes = {0: 16_000, 1: 4_000}
    quotas = splits.class_quotas(sizes, 0.2)
    in_band = splits._cuts_in_band(narrow, [1, 2], sizes, quotas, 8.0)
    assert in_band.count() == 4
    low, high = splits._band(quotas[0], sizes[0], 8.0)
    assert int(high[:-1], 16) - int(low, 16) < 0.06 * 16**splits.PREFIX
    expected = {(r["seed"], r["label"]): r["cut"] for r in splits.split_cuts(df, "id", "y", [1, 2]).collect()}
    monkeypatch.setattr(splits, "BANDS", (0.0001, splits.BANDS[-1]))
    found = {(r["seed"], r["label"]): r["cut"] for r in splits.split_cuts(df, "id", "y", [1, 2]).collect()}
    assert found == expected and len(found) == 4
