"""Every registered query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import connect, differences

ORACLE = entry.oracle_sql()


# Many fits: compared on the smallest tables.
FITS = {"evaluate_grid", "model_embedding_mlp"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - FITS))
def test_same_rows_as_sql(spark, data, con, name):
    frame = entry.queries()[name](spark, data)
    assert not differences(frame, con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(FITS))
def test_grids_have_all_rows(spark, small, name):
    frame = entry.queries()[name](spark, small)
    assert not differences(frame, connect(small), ORACLE[name])


def test_flags_never_and_always_set(spark):
    """A table of one row or column, through the operators and the SQL."""
    from riskloom.operators import flag_stats
    from riskloom.functions.pvalues import chi2_1dof_p
    from riskloom.registry import oracle

    rows = [(i, i % 6 == 0, 0, 1, i % 3 == 0) for i in range(200)]
    flags = ["never_set", "always_set", "now_and_then"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(job_id BIGINT, fraudulent_agent INT, never_set INT, always_set INT, now_and_then INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [tuple(map(int, r)) for r in rows])
    table = spark.createDataFrame([tuple(map(int, r)) for r in rows], "job_id long, fraudulent_agent int, never_set int, always_set int, now_and_then int")
    counted = flag_stats.contingency(table, flags)
    tested = flag_stats.chi2_yates(flag_stats.expected_cells(counted))
    cells = oracle._cells("t", "job_id", flags)
    sql = f"WITH {cells} SELECT flag, expected_min, {oracle._TEST} AS test, round(chi2, 6) AS chi2 FROM e"
    assert not differences(tested.select("flag", "expected_min", "test", F.round("chi2", 6).alias("chi2")), con, sql)
    prevalence = flag_stats.flag_prevalence(table, flags).withColumn("p_value", F.round("p_value", 6))
    want = con.execute(oracle._prevalence(cells, "t")).fetch_df().set_index("flag")
    found = prevalence.toPandas().set_index("flag")
    assert set(found.index) == set(want.index) == {"always_set", "now_and_then"}
    for column in ("flagged", "p_value", "test", "sig"):
        assert found[column].to_dict() == want[column].to_dict()
    rates = flag_stats.flag_rates(flag_stats.fisher_exact(tested)).withColumn("p", chi2_1dof_p("chi2"))
    assert {r["flag"]: (r["flagged"], r["p"] == 1.0) for r in rates.collect()} == {"always_set": (200, True), "now_and_then": (67, False)}


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and "relative_risk" in rows[0].asDict()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_results_do_not_depend_on_layout(spark, data):
    """One shuffle partition and many give the same rows."""
    names = ["spearman_continuous", "stratified_split", "average_precision_continuous", "nearest_neighbors"]
    seen = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            for name in names:
                rows = sorted(map(repr, entry.queries()[name](spark, data).collect()))
                assert seen.setdefault(name, rows) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_plan_pairs_all_rows(spark, small):
    """No cross or nested-loop join, with every automatic broadcast turned off."""
    eager = FITS | {q for q in ORACLE if q.startswith("model_")} | {"smote", "smote_rows", "smote_neighbors", "nearest_neighbors", "neighbor_index", "tfidf_svd", "feature_vectors", "feature_block_sizes"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in sorted(set(ORACLE) - eager):
            frame = entry.queries()[name](spark, small)
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
