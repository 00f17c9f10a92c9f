import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.columns import score_0_10, strip
from riskloom.operators import clean, salary, scoring
from riskloom.plans import jobs


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_target_names(spark):
    for name in ("fraudulent", "fraudulent_agent"):
        df = spark.createDataFrame([(1,)], f"{name} int")
        assert clean.normalize_target(df).columns == [fixed.LABEL]
    with pytest.raises(ValueError):
        clean.normalize_target(spark.createDataFrame([(1,)], "x int"))


def test_flag_and_score_coercion(spark):
    rows = [("1",), ("1.0",), (" 0 ",), ("x",), (None,), ("nan",), ("1d",)]
    df = spark.createDataFrame(rows, "flag1_sensitive_info string").withColumn(
        "risk_score_all", F.col("flag1_sensitive_info")
    )
    out = clean.coerce_scores(clean.coerce_flags(df))
    assert values(out, "flag1_sensitive_info") == [(1,), (1,), (0,), (0,), (0,), (0,), (0,)]
    assert values(out, "risk_score_all") == [(1.0,), (1.0,), (0.0,), (None,), (None,), (None,), (None,)]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.ensure_columns(df, {"b": "int", "c": "double"}).columns == ["a", "b", "c"]
    assert clean.keep_columns(df, ["b", "zz"]).columns == ["b"]
    assert clean.missing_columns(df, ["a", "zz"]) == ["zz"]


def test_strip_is_pythons(spark):
    texts = ["  a b\t\n", "　x ", "  ", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_rendering_leaves_out_blank_and_hidden_fields(spark):
    df = spark.createDataFrame(
        [(9, 1, " Clerk ", "NaN", "none", "d" * 900, 1.0)],
        "job_id bigint, fraudulent_agent int, title string, location string, department string, "
        "description string, telecommuting double",
    )
    text = clean.render_posting(df, "job_id").first()["posting_text"]
    assert text == "Title: Clerk\nTelecommuting: 1.0\nDescription: " + "d" * 700
    hidden = df.select(
        clean.rendered(df, [("Label", "fraudulent_agent"), ("Key", "job_id"), ("Title", "title")])
    ).first()[0]
    assert hidden == "Title: Clerk"


def test_sensitive_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 0, "t")], "job_id int, fraudulent_agent int, title string")
    assert clean.strip_sensitive(df).columns == ["title"]
    assert clean.strip_sensitive(df, keep_key="job_id").columns == ["job_id", "title"]


def test_salary_traps(spark):
    cases = {
        "50,000-60,000": (50.0, 0.0), "10-Nov": (11.0, 11.0), "market rate 5": (3.0, 3.0),
        "30000": (30000.0, 30000.0), "a 1 b 2 c 3": (1.0, 2.0), "": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "salary_range string")
    out = salary.parse_salary(df).collect()
    assert {r["salary_range"]: (r["salary_lower"], r["salary_upper"]) for r in out} == cases
    assert {r["salary_range"] for r in out if r["salary_range_missing"]} == {None}


def test_mean_fill_can_learn_from_training_rows_only(spark):
    train = spark.createDataFrame([(10.0,), (20.0,)], "salary_lower double")
    test = spark.createDataFrame([(None,), (100.0,)], "salary_lower double")
    out = salary.fill_mean(test, ["salary_lower"], fit_on=train)
    assert values(out, "salary_lower") == [(15.0,), (100.0,)]


def test_education_and_labels(spark):
    df = spark.createDataFrame([("Professional",), ("Other",), (None,)], "e string")
    assert [r[0] for r in df.select(clean.education_group(F.col("e"))).collect()] == ["Certification", "Other", None]
    df = spark.createDataFrame([(" a ,, b ",), (" , ",), (None,), ("",)], "l string")
    assert [r[0] for r in df.select(clean.label_list(F.col("l"))).collect()] == [
        ["a", "b"], ["__MISSING__"], ["__MISSING__"], ["__MISSING__"],
    ]


def test_half_even_and_clamp(spark):
    df = spark.createDataFrame([(2.5,), (6.5,), (7.5,), (-1.0,), (1e300,), (None,)], "s double")
    assert [r[0] for r in df.select(score_0_10(F.col("s"))).collect()] == [2, 6, 8, 0, 10, None]


def test_response_truth_matches_python(spark):
    members = [True, False, None, 0, 0.0, 1, -0.5, "", "false", "0", [], [0], {}, {"a": 1}]
    df = spark.createDataFrame(
        [(i, json.dumps({"flag1_sensitive_info": m, "extra": True})) for i, m in enumerate(members)]
        + [(90, "not json"), (91, None), (92, "[1]"), (93, "{}")],
        "i int, response string",
    )
    out = {r["i"]: r["flag1_sensitive_info"] for r in scoring.parse_flags(df).collect()}
    assert out == {**{i: int(bool(m)) for i, m in enumerate(members)}, 90: 0, 91: 0, 92: 0, 93: 0}


def test_response_score(spark):
    cases = [
        ('{"risk_score": 6.5}', 6), ('{"risk_score": 12}', 10), ('{"risk_score": "8"}', 8),
        ('{"risk_score": null}', None), ('{"risk_score": "high"}', None), ("{}", 0),
        ('{"risk_score": true}', 1), ('{"risk_score": "nan"}', None), ('{"risk_score": "inf"}', None),
        ("oops", None), (None, None), ('{"risk_score": []}', None),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "r string")
    got = [r["s"] for r in scoring.parse_score(df, "s", "r", default=0).collect()]
    assert got == [expected for _, expected in cases]
    empty = spark.createDataFrame([("{}",)], "r string")
    assert scoring.parse_score(empty, "s", "r").first()["s"] is None


def test_injected_scorer_failures_cost_one_row(spark):
    def scorer(texts):
        if texts.str.contains("bad").any():
            raise RuntimeError("no answer")
        return texts.map(lambda t: '{"risk_score": %d}' % len(t))

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "abcd")], "k int, t string").coalesce(1)
    out = scoring.score_with(df, "k", "t", scorer)
    assert {r["k"]: (r["ok"], r["response"]) for r in out.collect()} == {
        1: (True, '{"risk_score": 3}'), 2: (False, None), 3: (True, '{"risk_score": 4}'),
    }


def test_combinations(spark):
    assert scoring.combo_flag_names("all") == fixed.FLAGS
    assert scoring.combo_flag_names("legit_context") == [fixed.FLAG_BY_ID[i] for i in (1, 2, 3, 4, 7)]
    rows = scoring.combo_flags(spark).groupBy("combo").count().collect()
    assert {r["combo"]: r["count"] for r in rows} == {
        "all": 8, "legit_context": 5, "context_consist": 4, "legit_consist": 7,
    }


def test_overlay_writes_nulls_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, s int")
    new = spark.createDataFrame([(1, None, True), (2, 9, False)], "k int, s int, ok boolean")
    once = scoring.overlay_results(base, new, "k", ["s"], "ok")
    assert sorted(values(once, "k", "s"), key=str) == [(1, None), (2, 6), (3, 7)]
    twice = scoring.overlay_results(once, new, "k", ["s"], "ok")
    assert sorted(values(twice, "k", "s"), key=str) == sorted(values(once, "k", "s"), key=str)
    added = scoring.overlay_results(base, new.withColumnRenamed("s", "t"), "k", ["t"], "ok")
    assert added.columns == ["k", "s", "t"]


def test_range_selection(spark):
    df = spark.createDataFrame([(i * 10, i) for i in range(20)], "k int, v int")
    assert values(scoring.select_range(df, "k", 17).orderBy("k"), "v") == [(17,), (18,), (19,)]
    assert values(scoring.select_range(df, "k", 3, 4).orderBy("k"), "v") == [(3,), (4,)]
    for bad in ((5, 4), (0, 20), (20, -1)):
        with pytest.raises(ValueError):
            scoring.select_range(df, "k", *bad)


def test_progress_without_gaps(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "k int, risk_score_all int")
    row = scoring.scoring_progress(df, "k").first()
    assert (row["completed"], row["remaining"], row["first_unscored"], row["last_unscored"]) == (2, 0, None, None)


def test_weights_from_definitions(spark):
    df = spark.createDataFrame(
        [(1, {"indicative_strength": "strong", "frequency_in_fraud": "rare", "specificity_to_fraud": "high", "false_positive_risk": "low"}), (7, None)],
        "flag_id int, orchestrator map<string,string>",
    )
    assert scoring.calibration_weights(df) == {"flag1_sensitive_info": 27, "flag7_vague_info": 1}


def test_rules_cannot_read_the_label(spark):
    df = spark.createDataFrame([(1, 1, 5)], "job_id int, fraudulent_agent int, x int")
    out = jobs.score_records(df, {"flag1_sensitive_info": ("x > 3", None)}, {"flag1_sensitive_info": 3})
    assert out.first()["risk_score_all"] == 10
    with pytest.raises(AnalysisException):
        jobs.score_records(df, {"flag1_sensitive_info": ("fraudulent_agent = 1", None)}, {})


def test_score_selected_rows(spark):
    df = spark.createDataFrame([(i, "t" * i, 1) for i in range(1, 6)], "job_id bigint, title string, fraudulent_agent int")

    def scorer(texts: pd.Series) -> pd.Series:
        assert not texts.str.contains("fraud").any()
        return texts.map(lambda t: '{"risk_score": %d}' % (len(t) - len("Title: ")))

    out = jobs.score_selected(df, "job_id", scorer, 1, 3)
    assert {r["job_id"]: r["single_pass_risk_score"] for r in out.collect()} == {1: None, 2: 2, 3: 3, 4: 4, 5: None}


def test_agents_see_the_record_and_subsets_see_flags(spark):
    df = spark.createDataFrame([(1, "good", 1), (2, "bad", 0)], "job_id bigint, title string, fraudulent_agent int")

    def flag_scorer(agent, texts):
        if agent == "context" and texts.str.contains("bad").any():
            raise RuntimeError("no answer")
        assert texts.str.startswith("Title: ").all()
        flags = {fixed.FLAG_BY_ID[i]: True for i in fixed.AGENT_FLAG_IDS[agent]}
        return texts.map(lambda _: json.dumps(flags))

    def subset_scorer(combo, seen):
        assert not seen.str.contains("good").any()
        if combo == "legit_consist":
            raise RuntimeError("no answer")
        return seen.map(lambda s: json.dumps({"risk_score": sum(json.loads(s).values())}))

    out = {r["job_id"]: r for r in jobs.score_by_agents(df, "job_id", flag_scorer, subset_scorer).collect()}
    assert out[1]["flag4_anon_employer"] == 1 and out[2]["flag4_anon_employer"] == 0
    assert (out[1]["risk_score_all"], out[2]["risk_score_all"]) == (8, 7)
    assert (out[1]["risk_score_legit_context"], out[2]["risk_score_context_consist"]) == (5, 3)
    assert out[1]["risk_score_legit_consist"] is None
