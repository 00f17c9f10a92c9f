"""Every stage of the pipeline against a plain version on its own input."""

import duckdb
import pytest

import corpus_pipeline
from riskloom.llm import quality_classifier, queries, sentence_pieces, store
from riskloom.llm.oracle import OP1, OP10
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, small):
    """name -> (input rows, output rows) by doc_id."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = store.written(stage(spark, before, small))
        out[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()})
        before = after
    return out


def views(rows, small):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in rows.values()])
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{small}/benchmark.parquet'")
    return con


def test_quality(spark, small, stages):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{small}/labels.parquet").where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 != 2")
    model = quality_classifier.fit(spark.read.parquet(f"{small}/documents.parquet"), labels)
    scores = model.score([r.text for r in before.values()])
    assert set(after) == {i for i, s in zip(before, scores) if s >= quality_classifier.KEEP_FROM}


def test_lines(small, stages):
    before, after = stages["line_dedup"]
    wanted = views(before, small).execute(f"SELECT doc_id, text FROM ({OP10})").fetchall()
    assert {i: r.text for i, r in after.items()} == dict(wanted)
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_copies(stages):
    before, after = stages["ngram_jaccard_join"]
    groups = brute.near_copies([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (n, first) in groups.items() if i == first}


def test_contamination(small, stages):
    before, after = stages["benchmark_decontamination"]
    bad = views(before, small).execute(f"SELECT doc_id FROM ({OP1}) WHERE contaminated").fetchall()
    assert set(after) == set(before) - {i for (i,) in bad}


def test_pieces(stages):
    before, after = stages["sentencepiece"]
    vocabulary = sentence_pieces.Vocabulary(queries.tokenizer_file(queries.PIECE_MODEL))
    some = sorted(after)[:50]
    assert set(after) == set(before)
    assert {i: list(after[i].ids) for i in some} == {i: brute.best_path(vocabulary, before[i].text) for i in some}


def test_run(spark, small, stages):
    rows = corpus_pipeline.run(spark, small).collect()
    last = stages["sentencepiece"][1]
    assert {r.doc_id: list(r.ids) for r in rows} == {i: list(r.ids) for i, r in last.items()}
    assert all(r.n_ids == len(r.ids) for r in rows)
