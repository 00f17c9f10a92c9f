import contextlib
import csv
import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators import agreement, coverage, paired, results, scoring
from riskloom.plans import jobs, reports
from riskloom.sources import definitions, postings, tables
from riskloom.sources import results as result_files
from riskloom.streaming.score_new import score_arriving


def test_read_postings(spark, tmp_path):
    text = 'title,job_id,description,telecommuting,fraudulent,flag1_sensitive_info,risk_score_all\n' \
           '"Chef, caf\xe9",7,"line one\nline ""two""",1.0,0,1.0,9.0\nPlain,8,,,1,,\n'
    (tmp_path / "p.csv").write_bytes(text.encode("latin-1"))
    rows = postings.read_postings(spark, str(tmp_path / "p.csv")).orderBy("job_id").collect()
    assert rows[0]["title"] == "Chef, café" and rows[0]["description"] == 'line one\nline "two"'
    assert (rows[0]["job_id"], rows[0]["telecommuting"], rows[0]["flag1_sensitive_info"]) == (7, 1, 1)
    assert rows[0]["risk_score_all"] == 9.0 and rows[1]["risk_score_all"] is None
    assert [r[fixed.LABEL] for r in rows] == [0, 1] and "fraudulent" not in rows[0].asDict()


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_encoding_fallback(spark, tmp_path, encoding):
    (tmp_path / "s.csv").write_bytes("sample_id,note\n1,caf\xe9\n".encode(encoding))
    assert postings.read_csv_fallback(spark, str(tmp_path / "s.csv")).first()["note"] == "café"


def test_valid_utf8_may_hold_the_replacement_sign(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("sample_id,note\n1,caf\xe9\n2,\ufffd\n".encode())
    rows = postings.read_csv_fallback(spark, str(tmp_path / "s.csv")).collect()
    assert [r["note"] for r in rows] == ["caf\xe9", "\ufffd"]


def long_results(spark):
    rows = [
        (seed, model, grp, metric, 0.5 + seed / 100 + 0.1 * (grp == "single_pass"))
        for seed in (1, 2, 3) for model in ("lr", "bert_mlp") for grp in ("base", "single_pass")
        for metric in fixed.METRICS
    ]
    return spark.createDataFrame(rows, "random_state bigint, model string, grp string, metric string, value double")


def test_result_files_round_trip(spark, tmp_path):
    long = long_results(spark)
    wide = results.results_wide(long.where("model = 'bert_mlp'"), results.result_names(["bert_mlp"], ["base", "single_pass"]))
    for run in ("rs51-53", "rs1-3"):
        wide.toPandas().to_csv(tmp_path / f"BERT_MLP_results_{run}.csv", index=False)
    (tmp_path / "other_results_rs9.csv").write_text("x\n")
    assert result_files.discover_result_sets(spark, str(tmp_path)) == ["rs1-3", "rs51-53"]
    back = result_files.load_results(spark, str(tmp_path), "rs1-3")
    assert back.exceptAll(long.where("model = 'bert_mlp'")).count() == 0 and back.count() == 24
    with pytest.raises(FileNotFoundError):
        result_files.load_results(spark, str(tmp_path), "rs7-8")
    result_files.write_results(long, str(tmp_path / "out"), "rs1-3")
    written = spark.read.option("header", True).csv(str(tmp_path / "out" / "LR_results_rs1-3.csv"))
    assert written.columns[:3] == ["random_state", "lr_base_accuracy", "lr_base_recall"]


def test_constant_differences(spark):
    long = long_results(spark)
    same = long.withColumn("value", F.lit(0.5))
    row = paired.compare_groups(same).first()
    assert (row["t_statistic"], row["cohens_d"], row["significant"]) == (None, 0.0, "No")
    shifted = same.withColumn("value", F.when(F.col("grp") == "base", 0.25).otherwise(0.75))
    row = paired.compare_groups(shifted).first()
    assert (row["t_statistic"], row["p_value"], row["significant"]) == (float("inf"), 0.0, "Yes")


def test_definitions(spark, tmp_path):
    body = {"flags": [
        {"flag_id": 1, "detection_agent": {"trigger_criteria": ["a", "b"]}, "orchestrator": {"indicative_strength": "strong"}},
        {"flag_id": 4, "name": "x"},
    ]}
    (tmp_path / "d.json").write_text(json.dumps(body, indent=1))
    defs = definitions.load_flag_definitions(spark, str(tmp_path / "d.json"))
    assert defs.count() == 2
    assert definitions.definitions_for(defs, [4, 9]).collect()[0]["detection_agent"] == {}
    assert scoring.calibration_weights(defs) == {"flag1_sensitive_info": 3, "flag4_anon_employer": 1}


def test_embeddings_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, [0.5, 1.5])], "job_id bigint, embedding array<double>")

    path = str(tmp_path / "emb")
    assert tables.read_embeddings(spark, path) is None
    for _ in range(2):
        out = tables.cached_embeddings(spark, path, "job_id", build)
        assert out.first()["embedding"] == [0.5, 1.5]
    assert calls == [1]


@contextlib.contextmanager
def small_splits(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def by_one_task(spark, path, encoding="UTF-8"):
    """Spark's own reader of quoted line breaks."""
    return (
        spark.read.option("header", True).option("encoding", encoding).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


PARTS = ["", "a", "b c", ",", "\n", '"', '""', "\n\n", "x\n,y", 'say "no"', "é", "  ", '",', '"\n', "long " * 12]


@pytest.mark.parametrize("seed,end,encoding,quoting", [
    (1, "\n", "UTF-8", csv.QUOTE_MINIMAL), (2, "\r\n", "ISO-8859-1", csv.QUOTE_MINIMAL), (3, "\n", "ISO-8859-1", csv.QUOTE_ALL),
    (4, "\r\n", "UTF-8", csv.QUOTE_NONNUMERIC),
])
def test_split_csv_equals_the_reader_of_whole_files(spark, tmp_path, seed, end, encoding, quoting):
    rng = random.Random(seed)
    for name in ("one", "two"):
        rows = [[str(i), *("".join(rng.choice(PARTS) for _ in range(rng.randrange(4))) for _ in range(3))] for i in range(60)]
        with open(tmp_path / f"{name}.csv", "w", encoding=encoding, newline="") as out:
            writer = csv.writer(out, lineterminator=end, quoting=quoting)
            writer.writerow(["id", "first\nname", "b", "c"])
            writer.writerows(rows)
    path = str(tmp_path / "*.csv")
    want = by_one_task(spark, path, encoding)
    key = lambda r: [(x is None, x or "") for x in r]
    expected = sorted(map(tuple, want.collect()), key=key)
    assert len(expected) == 120
    for size in (40, 300, 5000):
        with small_splits(spark, size):
            found = postings.read_text_csv(spark, path, encoding)
            assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=key) == expected


def test_one_large_file_is_many_tasks(spark, tmp_path):
    """Also a field that is longer than several chunks, and stray quotes within unquoted fields."""
    rows = [f'{i},"line {i}\nbreak, ""quoted""",5" wide' for i in range(300)]
    rows[100] = '100,"' + "much\n" * 800 + '",long'
    (tmp_path / "t.csv").write_text("\n".join(["id,text,more", *rows, ""]))
    path = str(tmp_path / "t.csv")
    with small_splits(spark, 500):
        lines = spark.read.option("lineSep", "\n").text(path)
        assert lines.rdd.getNumPartitions() > 20
        found = sorted(tuple(r) for r in postings.read_text_csv(spark, path).collect())
    assert found == sorted(tuple(r) for r in by_one_task(spark, path).collect()) and len(found) == 300
    (tmp_path / "e.csv").write_text("id,text,more\n")
    assert postings.read_text_csv(spark, str(tmp_path / "e.csv")).collect() == []


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c')], "k int, t string")
    tables.write_table(df, str(tmp_path / "c"), "csv")
    assert postings.read_text_csv(spark, str(tmp_path / "c")).first()["t"] == 'a "b", c'
    tables.write_scored(df, str(tmp_path / "p"), source=str(tmp_path / "c"))
    with pytest.raises(ValueError):
        tables.write_scored(df, str(tmp_path / "p"), source=str(tmp_path / "p") + "/")


def test_arriving_files_are_scored_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(rows):
        spark.createDataFrame(rows, "k bigint, flag1_sensitive_info int").coalesce(1).write.mode("append").parquet(source)

    def score(df):
        return scoring.weighted_risk(df, {"flag1_sensitive_info": 2}).select("k", "risk_score_all")

    def catch_up():
        schema = spark.read.parquet(source).schema
        score_arriving(spark, source, schema, "k", score, target, checkpoint).awaitTermination()
        return {r["k"]: r["risk_score_all"] for r in spark.read.parquet(target).collect()}

    arrive([(1, 1), (2, 0), (2, 0)])
    assert catch_up() == {1: 10, 2: 0}
    arrive([(2, 1), (3, 1)])  # key 2 has a score already and keeps it
    assert catch_up() == {1: 10, 2: 0, 3: 10}
    assert spark.read.parquet(target).count() == 3
    assert catch_up() == {1: 10, 2: 0, 3: 10}


def test_a_repeated_batch_scores_the_same_rows(spark, tmp_path):
    """Of rows with one key the choice does not depend on their order."""
    rows = [(k, x) for k in range(5) for x in range(20)]
    chosen = []
    for run, order in enumerate((rows, rows[::-1])):
        source = str(tmp_path / f"in{run}")
        spark.createDataFrame(order, "k int, x int").repartition(1 + 3 * run).write.parquet(source)
        schema = spark.read.parquet(source).schema
        target = str(tmp_path / f"out{run}")
        score_arriving(spark, source, schema, "k", lambda d: d, target, str(tmp_path / f"c{run}")).awaitTermination()
        chosen.append(sorted((r.k, r.x) for r in spark.read.parquet(target).collect()))
    assert chosen[0] == chosen[1] and len(chosen[0]) == 5


def test_a_failed_batch_is_repeated_whole(spark, tmp_path):
    """The state goes back with the batch: nothing is lost, nothing scored twice."""
    source, target, checkpoint, flag = (str(tmp_path / n) for n in ("in", "out", "cp", "failed"))

    def score(df):
        def once(batches):
            import os

            for batch in batches:
                if (batch["k"] == 7).any() and not os.path.exists(flag):
                    open(flag, "w").close()
                    raise RuntimeError("lost")
                yield batch

        return df.mapInPandas(once, df.schema)

    schema = "k bigint, x string"
    for batch in ([(1, "a"), (2, "b")], [(2, "c"), (7, "d"), (7, "e"), (8, "f")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        query = score_arriving(spark, source, spark.read.parquet(source).schema, "k", score, target, checkpoint, max_files=1)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            query = score_arriving(spark, source, spark.read.parquet(source).schema, "k", score, target, checkpoint, max_files=1)
            query.awaitTermination()
    assert os.path.exists(flag)
    rows = spark.read.parquet(target).collect()
    assert sorted((r.k, r.batch_id) for r in rows) == [(1, 0), (2, 0), (7, 1), (8, 1)]
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress] == [4]
    assert [p["stateOperators"][0]["customMetrics"]["rocksdbPutCount"] for p in progress] == [2]


def test_a_batch_reads_no_results(spark, tmp_path):
    """Work follows the batch: the plan of the last batch has its own files only."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    plans = []

    def score(df):
        plans.append(df._jdf.queryExecution().toString())
        return df

    done = spark.createDataFrame([(k,) for k in range(50)], "k bigint")
    for k in range(3):
        spark.range(40 * k, 40 * k + 60).selectExpr("id AS k", "'x' AS x").coalesce(1).write.mode("append").parquet(source)
        score_arriving(spark, source, spark.read.parquet(source).schema, "k", score, target, checkpoint, scored=done).awaitTermination()
    assert len(plans) == 3 and not any(target in p for p in plans)
    found = sorted(r.k for r in spark.read.parquet(target).collect())
    assert found == list(range(50, 140))


def flagged(spark, rows):
    return spark.createDataFrame(rows, "k bigint, a int, b int, fraudulent_agent int")


def test_greedy_prefers_rows_that_help_most(spark):
    df = flagged(spark, [(1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 1, 0), (5, 0, 0, 1)])
    assert coverage.greedy_keys(df, "k", ["a", "b"], n_total=4, target=2) == [2, 1, 3]
    assert coverage.greedy_keys(df, "k", ["a", "b"], n_total=2, target=2) == [2, 1]
    assert coverage.greedy_keys(df, "k", ["a", "b"], n_total=0, target=2) == []
    short = coverage.coverage_report(coverage.greedy_coverage(df, "k", ["a", "b"], 9, 3), ["a", "b"], 3)
    assert {r["flag"]: r["status"] for r in short.collect()} == {"a": "short by 1", "b": "OK"}


def test_fill_keeps_half_positive_as_far_as_possible(spark):
    df = flagged(spark, [(i, 0, 0, int(i < 3)) for i in range(20)])
    out = coverage.fill_stratified(df, "k", [19], n_total=11).collect()
    assert len(out) == 11 and sum(r["fraudulent_agent"] for r in out) == 3
    assert coverage.fill_stratified(df, "k", [19], n_total=1).count() == 1
    all_positive = flagged(spark, [(i, 0, 0, 1) for i in range(20)])
    assert coverage.fill_stratified(all_positive, "k", [], n_total=9).count() == 9
    assert coverage.fill_stratified(df.drop("fraudulent_agent"), "k", [], n_total=7).count() == 7


def test_review_package_hides_label_and_flags(spark, data):
    from riskloom.registry.views import Views

    df = Views(spark, data).postings().withColumn("flag7_vague_info", (F.col("job_id") % 5 == 0).cast("int"))
    package = jobs.review_package(df)
    sheet = package["sample_for_review"]
    assert not {fixed.LABEL, "risk_score_all", *fixed.FLAGS} & set(sheet.columns)
    assert sheet.columns[-8:] == fixed.MANUAL_FLAGS
    rows = sheet.collect()
    assert len(rows) == 50 and sorted(r["sample_id"] for r in rows) == list(range(1, 51))
    assert package["ai_flags_reference"].columns[:3] == ["sample_id", "job_id", "flag7_vague_info"]
    assert sum(r["records"] for r in package["flag_counts"].collect()) == 50


def test_totals_rows_and_unusable_cells_drop_out(spark):
    reference = spark.createDataFrame([(1, 10, 1), (2, 20, 0), (3, 30, 1)], "sample_id int, job_id int, flag1_sensitive_info int")
    review = spark.createDataFrame(
        [("1", "0"), ("2.0", "1"), ("3", ""), ("Total", "1"), ("9", "1")],
        "sample_id string, manual_flag1_sensitive_info string",
    )
    matched = agreement.match_labels(review, reference)
    row = agreement.confusion_by_flag(matched).first()
    assert (row["n_compared"], row["fp"], row["fn"], row["agreement_pct"]) == (2, 1, 1, 0.0)
    found = agreement.sorted_disagreements(agreement.disagreements(matched, ["sample_id", "job_id"])).collect()
    assert [(r["sample_id"], r["ai_label"], r["human_label"], r["type"]) for r in found] == [
        (1, 1, 0, fixed.FALSE_POSITIVE), (2, 0, 1, fixed.FALSE_NEGATIVE),
    ]
    assert reports.human_report(review, reference).columns[-1] == "Cohens Kappa"


def test_reports(spark, small):
    from riskloom.registry.views import Views

    out = jobs.flag_report(Views(spark, small).orders())
    prevalence = out["flag_prevalence_analysis"].collect()
    risks = [r["Relative Risk"] for r in prevalence]
    assert risks == sorted(risks, reverse=True) and prevalence[0]["Flag"] in fixed.FLAG_LABELS.values()
    assert out["flag_agreement_analysis"].collect()[-1]["Number of Flags Fired"] == "Spearman ρ"
    assert {r["Column"] for r in out["risk_score_distribution"].collect()} == set(fixed.SCORES)
    assert reports.comparison_report(long_results(spark)).columns[-1] == "significant"


def test_small_helpers(spark):
    from riskloom.functions.layout import spread
    from riskloom.operators.flag_stats import round_report

    df = spark.createDataFrame([(0.125, 2.5, "x")], "a double, b double, c string")
    row = round_report(df, {"a": 2, "b": 0, "absent": 1}).first()
    assert (row["a"], row["b"]) == (0.12, 2.0)
    tests = spark.createDataFrame([("m1", 0.049), ("m1", 0.05), ("m2", None)], "model string, p_value double")
    marked = paired.mark_significant(paired.union_results([tests, tests]))
    assert {r["model"]: (r["significant"], r["total"]) for r in paired.model_significance(marked).collect()} == {
        "m1": (2, 4), "m2": (0, 2),
    }
    assert spread(df, "c") is df  # no files, so nothing is moved


def test_evaluation_run_resumes_and_writes(spark, tmp_path, monkeypatch):
    from riskloom.operators import models
    from riskloom.plans import jobs

    fits = []

    def grid(df, key, label, seeds, names, groups, **options):
        names = list(names)
        fits.append((seeds[0], tuple(names), tuple(groups)))
        rows = [(s, m, g, k, 0.25 * s + 0.01 * i) for s in seeds for m in names for g in groups for i, k in enumerate(fixed.METRICS)]
        return spark.createDataFrame(rows, "random_state bigint, model string, grp string, metric string, value double")

    monkeypatch.setattr(models, "evaluate_grid", grid)
    df = spark.createDataFrame([(1, 0, 1.0)], "k int, y int, a double")
    groups = {"base": ["a"], "single_pass": ["a"], "multi_agent_all": ["absent"]}
    folder = str(tmp_path / "results")
    jobs.evaluation_run(df, "k", "y", folder, 1, 1, ["lr"], groups)
    summary = jobs.evaluation_run(df, "k", "y", folder, 1, 2, ["lr", "rf"], groups)
    both = ("base", "single_pass")
    assert fits == [(1, ("lr",), both), (1, ("rf",), both), (2, ("lr", "rf"), both)]
    assert [tuple(r)[:3] for r in summary.collect()] == [("LR", g, 0.375) for g in both] + [("RF", g, 0.375) for g in both]
    back = result_files.load_results(spark, folder, "rs1-2")
    assert back.count() == 2 * 2 * 2 * len(fixed.METRICS)
    assert len(spark.read.option("header", True).csv(f"{folder}/summary_means_rs1-2.csv").collect()) == 4
    jobs.evaluation_run(df, "k", "y", folder, 1, 2, ["lr", "rf"], groups)
    assert len(fits) == 3


def test_comparison_run(spark, tmp_path):
    from riskloom.plans import jobs

    result_files.write_results(long_results(spark), str(tmp_path), "rs1-3")
    out = jobs.comparison_run(spark, str(tmp_path))
    written = spark.read.option("header", True).csv(str(tmp_path / "statistical_comparisons_rs1-3.csv"))
    assert written.count() == out["comparisons"].count() == 2 * len(fixed.METRICS)
    assert {round(float(r["mean_diff"]), 6) for r in written.collect()} == {0.1}
    assert out["significance_counts"].first()["total"] == 2 * len(fixed.METRICS)
    result_files.write_results(long_results(spark), str(tmp_path), "rs4-6")
    with pytest.raises(ValueError):
        jobs.comparison_run(spark, str(tmp_path))


def test_agreement_run(spark, tmp_path):
    from riskloom.plans import jobs

    flag = fixed.FLAGS[0]
    reference = spark.createDataFrame([(1, 10, 1), (2, 11, 0), (3, 12, 1)], f"sample_id int, job_id int, {flag} int")
    review = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "0"), ("Total", "2")], f"sample_id string, manual_{flag} string")
    out = jobs.agreement_run(review, reference, str(tmp_path / "agreement"))
    assert {(r["type"], r["records"]) for r in out["disagreement_counts"].collect()} == {(fixed.FALSE_POSITIVE, 1), (fixed.FALSE_NEGATIVE, 1)}
    written = spark.read.option("header", True).csv(str(tmp_path / "agreement" / "manual_vs_ai_disagreements.csv"))
    assert sorted(r["sample_id"] for r in written.collect()) == ["2", "3"]
    figures = spark.read.option("header", True).csv(str(tmp_path / "agreement" / "manual_vs_ai_comparison.csv")).first()
    assert (figures["True Positive"], figures["False Positive"], figures["Agreement (%)"]) == ("1", "1", "33.3")
