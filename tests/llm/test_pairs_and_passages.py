"""Near copies, contamination, repeated passages and recurring lines."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.llm import components, decontamination, line_dedup, ngram_join, substring_dedup
from riskloom.llm.bytes_np import shingle_hashes, word_hashes
from tests.llm import brute

SCHEMA = "doc_id long, text string, doc string, term string, pos string, id string, n string, digest string"


def table(spark, rows):
    """A table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copy_rows(seed=3):
    """Families of near copies, one hot shared passage, copies, nulls, empty and long texts."""
    rng = random.Random(seed)
    shared = words(rng, 20)
    rows, at = [], 0
    for _ in range(8):
        base = words(rng, rng.choice([6, 30, 60, 150])) + shared
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n\t "), (at + 3, "one"), (at + 4, "One"), (at + 5, "one two three")]
    rows += [(at + 6, " ".join(shared)), (at + 7, " ".join(shared).upper()), (at + 8, " ".join(words(rng, 9000)))]
    return rows


def test_near_copies_as_by_brute_force(spark):
    rows = near_copy_rows()
    found = {r.id: (r.n, r.component) for r in ngram_join.similar_components(table(spark, rows)).collect()}
    assert found == brute.near_copies(rows)


def test_near_copies_do_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 40)
    monkeypatch.setattr(ngram_join, "PACK_NGRAMS", 50)
    rows = near_copy_rows(5)
    found = {r.id: (r.n, r.component) for r in ngram_join.similar_components(table(spark, rows)).collect()}
    assert found == brute.near_copies(rows)


def test_near_copies_of_repeated_and_missing_ids(spark):
    text = " ".join(words(random.Random(1), 40))
    rows = [(5, text), (5, text), (2, text), (None, text), (5, "quite another text than the first one"), (9, "quite another text than the first one")]
    found = sorted((r.id or -1, r.n, r.component) for r in ngram_join.similar_components(table(spark, rows)).collect())
    assert found == sorted([(-1, 37, None), (2, 37, 2), (5, 37, 2), (5, 37, 2), (5, 4, 2), (9, 4, 2)])
    kept = ngram_join.one_of_each(table(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2]


def test_bounds_hold_for_all_sizes():
    for n in range(1, 700):
        low, high = -(-85 * n // 100), 100 * n // 85
        hidden = [m - ngram_join.shown(m) for m in range(high + 1)]
        sure = min(ngram_join.least_overlap(n, m) - max(hidden[n], hidden[m]) for m in range(low, high + 1))
        assert 1 <= ngram_join.sure_overlap(n) <= max(1, sure) and sure >= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tÄé", max_size=30), min_size=2, max_size=6))
def test_equal_words_have_equal_hashes(texts):
    seen = {}
    for text in texts:
        for h, w in zip(word_hashes(text).tolist(), brute.folded_words(text), strict=True):
            assert seen.setdefault(h, w) == w
        assert len(set(shingle_hashes(word_hashes(text), 4).tolist())) == len(brute.ngrams(text))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "short item"), (3, None), (4, ""),
    (5, "SHORT, item!"), (6, "the the the the the the the the the the the the the the"), (None, "another short one"), (7, "ÀB k"),
]


def contamination_rows():
    long = " ".join(words(random.Random(4), 6000))
    passage = ITEMS[0][1]
    return [
        (1, f"before {passage} after"), (2, passage.upper().replace(" ", "-- ")), (3, " ".join(passage.split()[:12])), (4, " ".join(passage.split()[1:14])),
        (5, "a short item here, and a Short Item there"), (6, None), (7, ""), (8, f"{long} {passage} {long}"), (9, " ".join(["the"] * 30)),
        (10, "Àb k"), (11, "àb k"), (12, "nothing of that"), (13, "another short one"), (14, "ShortItem short x item"), (15, f"{passage} x {passage}"),
    ]


def test_contamination_as_by_brute_force(spark):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, passage string")
    rows = contamination_rows()
    found = {r.id: (r.n_words, r.n_hit, r.items) for r in decontamination.contamination(table(spark, rows), items).collect()}
    named = [("" if i is None else i, t) for i, t in ITEMS]
    assert found == {i: brute.hits(t, named) for i, t in rows}


def test_contamination_of_repeated_ids_and_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, "short item"), (1, "short item"), (1, "clean"), (None, "a short item"), (None, None)]
    found = sorted((r.id or 0, r.n_words, r.n_hit) for r in decontamination.contamination(table(spark, rows), items).collect())
    assert found == [(0, 0, 0), (0, 3, 2), (1, 1, 0), (1, 2, 2), (1, 2, 2)]
    kept = decontamination.without_contaminated(table(spark, rows), items)
    assert sorted(r.text or "" for r in kept.collect()) == ["", "clean"] and len(kept.columns) == 8
    assert decontamination.contamination(table(spark, []), items).count() == 0
    nothing = decontamination.contamination(table(spark, rows), items.limit(0)).collect()
    assert len(nothing) == 5 and not any(r.n_hit for r in nothing)


def test_words_of_every_kind_of_character(spark):
    odd = [*map(chr, range(1, 128)), "\x80", "é", "İ", "Σ", "\u2028", "\u3000", "\ufffd", "中", "\U0001f600", "\U0010ffff"]
    rows = [(i, f"a{c}b {c} {c}{c}Z9") for i, c in enumerate(odd)] + [(-1, None), (-2, ""), (-3, "..."), (-4, "".join(odd))]
    taken = table(spark, rows).select("doc_id", decontamination.raw_words(F.col("text")).alias("words"))
    # A negated class of several ranges is many times dearer in Java.
    assert "[^" not in taken._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.words for r in taken.collect()} == {i: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for i, t in rows}


def test_an_index_takes_the_digest_and_the_words_of_a_text_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(
        decontamination.store, "written", lambda df, **options: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    )
    rows = [(1, "Short  item"), (1, "Short  item"), (2, None), (None, "x"), (3, "")]
    index = decontamination.build_index(table(spark, rows))
    sizes = index.postings.groupBy("doc").agg(F.max("pos").alias("last"), F.count("*").alias("n"))
    assert sorted((r["last"], r["n"]) for r in sizes.collect()) == [(0, 1), (1, 4)]
    (plan,) = plans
    each_word, each_text = plan.split("Generate", 1)
    # What stands above the explode runs for every word.
    assert "text#" not in each_word and "xxhash64(cast(doc_id" in each_text
    assert plan.count("regexp_extract_all") == 1


def test_proximity(spark):
    rows = [(1, "x alpha y beta z gamma"), (2, "gamma beta alpha"), (3, "alpha " + "q " * 50 + "beta gamma"), (4, "alpha beta"), (5, "solo")]
    index = decontamination.build_index(table(spark, rows))
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "solo")], "item_id long, text string")
    passages, members = decontamination.passages_of(items)
    near = decontamination.near_matches(index, passages, 5).join(members, "passage")
    keys = {r.doc: r.doc_id for r in table(spark, rows).select("doc_id", decontamination.row_key("doc_id", "text").alias("doc")).collect()}
    found = {(keys[r.doc], r.item, r["first"], r["last"]) for r in near.collect()}
    assert found == {(1, "1", 1, 5), (2, "1", 0, 2), (5, "2", 0, 0)}


def passage_rows():
    rng = random.Random(6)
    passage = words(rng, 70, 10**6)
    rows = [(i, " ".join(words(rng, 60, 10**6) + (passage if i in (3, 7, 9) else []) + words(rng, 60, 10**6))) for i in range(12)]
    rows[7] = (7, rows[7][1].upper())
    return rows, passage


def test_repeated_passages_are_cut_where_they_stand(spark):
    rows, passage = passage_rows()
    rows += [(20, None), (21, ""), (22, "too short to count"), (23, "too short to count")]
    found = substring_dedup.repeated_passages(table(spark, rows)).collect()
    texts = dict(rows)
    assert {r.id for r in found} == {7, 9} and {r.kept for r in found} == {3}
    for r in found:
        cut = texts[r.id][r.start : r.end].lower().split()
        # What other words share units with at the ends may stay.
        assert len(cut) == r.n_words >= 45 and " ".join(cut) in " ".join(passage)
    rest = {r.doc_id: r.text for r in substring_dedup.without_passages(table(spark, rows)).collect()}
    assert {i for i in rest if rest[i] != texts[i]} == {7, 9} and len(rest) == len(rows)
    for r in found:
        assert rest[r.id] == texts[r.id][: r.start] + texts[r.id][r.end :]


def test_a_text_that_repeats_itself_and_copies(spark):
    rng = random.Random(8)
    block = " ".join(words(rng, 90, 10**6))
    rows = [(1, f"{block}\n{block}"), (2, block), (None, block)]
    found = sorted((r.id or 0, r.kept) for r in substring_dedup.repeated_passages(table(spark, rows)).collect())
    assert found == [(0, 1), (1, 1), (2, 1)]
    assert substring_dedup.repeated_passages(table(spark, [])).count() == 0
    assert substring_dedup.without_passages(table(spark, [])).count() == 0


def test_short_passages_inside_lines_are_cut_whole(spark):
    """Passages of 30 to 70 words inside a line, 120 of them, each cut from its first to its last word."""
    rows, wanted = [], {}
    for seed in range(120):
        rng = random.Random(seed)
        passage = words(rng, 51 + seed % 10 if seed < 100 else 30 + 2 * (seed - 100), 10**9)
        a, b, c, d = (" ".join(words(rng, rng.randrange(80), 10**9)) for _ in range(4))
        rows += [(2 * seed, f"{a} {' '.join(passage)} {b}"), (2 * seed + 1, f"\u00c4\u20ac {c} {', '.join(passage).upper()}. {d}")]
        start = len(f"\u00c4\u20ac {c} ")
        wanted[2 * seed + 1] = (start, start + len(", ".join(passage)), len(passage), 2 * seed)
    found = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r.id: (r.start, r.end, r.n_words, r.kept) for r in found} == wanted and len(found) == len(wanted)


@pytest.mark.parametrize("run_words", [4, 12, 30])
def test_passages_as_by_brute_force(spark, run_words):
    rng = random.Random(run_words)
    rows = [(i, " ".join(words(rng, rng.randrange(150), 2 if i % 3 else 40))) for i in range(30)]
    rows += [(40, "x " * 90), (41, "x y " * 45), (42, rows[4][1]), (None, rows[4][1] + " " + rows[5][1])]
    found = substring_dedup.repeated_passages(table(spark, rows), run_words=run_words).collect()
    ranked = [(10**9 if i is None else i, t) for i, t in rows]
    cut = sorted((10**9 if r.id is None else r.id, r.start, r.end, r.n_words, r.kept) for r in found)
    assert cut == sorted(brute.repeated_passages(ranked, run_words)) and cut


def test_passages_of_short_lines_are_cut(spark):
    """Lists and verse: lines of one or two words, as copies of whole documents and inside other texts."""
    rng = random.Random(13)
    listed = "\n".join(" ".join(words(rng, rng.choice([1, 2]), 10**9)) for _ in range(60))
    rows = [(1, listed), (2, listed), (3, f"other words before it\n{listed}\nand behind it"), (4, listed.replace("\n", " - "))]
    found = {r.id: (r.start, r.end, r.n_words, r.kept) for r in substring_dedup.repeated_passages(table(spark, rows)).collect()}
    n = len(listed.split())
    assert found == {2: (0, len(listed), n, 1), 3: (22, 22 + len(listed), n, 1), 4: (0, len(rows[3][1]), n, 1)}


def line_rows():
    rng = random.Random(9)
    rows = []
    for i in range(30):
        lines = [" ".join(words(rng, 9, 10**6)) for _ in range(5)]
        lines.insert(i % 5, f"Posted by user number {i} on this page")
        if i < 12:
            lines.insert(2, "All rights reserved by the author")
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(" ".join(words(rng, 8, 10**6)) for _ in range(4))
    rows += [(100 + i, copy) for i in range(15)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "Of."), (204, "x " * 5000)]


def test_recurring_templates_go_and_copies_stay(spark):
    rows = line_rows()
    found = {r.doc_id: r for r in line_dedup.drop_recurring_lines(table(spark, rows), count_col="n").collect()}
    for i, text in rows:
        left = None if text is None else "\n".join(
            x for x in text.split("\n") if not x.startswith(("Posted by", "All rights"))
        )
        assert found[i].text == left and found[i].n == (0 if text is None else text.count("\n") - left.count("\n"))
    assert line_dedup.drop_recurring_lines(table(spark, [])).count() == 0
    repeated = line_dedup.drop_recurring_lines(table(spark, rows[:2] * 20 + [(None, rows[0][1])]))
    assert repeated.count() == 41


def test_copies_of_one_holder_do_not_keep_a_template_elsewhere(spark):
    """A line in 30 different texts, one of which has 60 copies, goes from all; the copies keep their other lines."""
    rng = random.Random(14)
    shared = "All rights reserved by the author"
    texts = ["\n".join([shared, *(" ".join(words(rng, 9, 10**9)) for _ in range(5))]) for _ in range(30)]
    rows = list(enumerate(texts)) + [(100 + i, texts[0]) for i in range(60)]
    found = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(table(spark, rows)).collect()}
    assert found == {i: t.split("\n", 1)[1] for i, t in rows}


def test_templates_with_many_variable_fields(spark):
    rng = random.Random(15)
    rows, wanted = [], {}
    for i in range(30):
        own = [" ".join(words(rng, 9, 10**9)) for _ in range(5)]
        fields = [f"2024-05-{i:02} 12:00:{i} INFO worker {i} started job 99{i}", f"Posted on {i} March 2024 at 10:{i}", "2024 01 02 13:00", f"{i} {i} {i}"]
        rows.append((i, "\n".join([fields[0], own[0], *fields[1:], *own[1:]])))
        wanted[i] = "\n".join([own[0], fields[3], *own[1:]])
    found = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(table(spark, rows)).collect()}
    assert found == wanted


def test_boilerplate_that_stands_together(spark):
    """Headers and footers do not shield one another; near copies keep their common lines."""
    rng = random.Random(16)
    frame = ["Read more in our archive", "Terms and conditions of this site", "Follow us on the usual channels"]
    rows = [(i, "\n".join([frame[0], *(" ".join(words(rng, 9, 10**9)) for _ in range(4)), *frame[1:]])) for i in range(40)]
    base = [" ".join(words(rng, 9, 10**9)) for _ in range(8)]
    rows += [(100 + i, "\n".join([*base[:5], " ".join(words(rng, 9, 10**9)), *base[5:]])) for i in range(40)]
    rows += [(200 + i, frame[0]) for i in range(3)] + [(300 + i, f"A page of one line by writer {i}") for i in range(20)]
    found = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(table(spark, rows)).collect()}
    assert found == {i: "\n".join(x for x in t.split("\n") if x not in frame) for i, t in rows}


def test_line_sql_on_the_same_rows(spark):
    from riskloom.llm.oracle import OP10
    from tests.compare import differences

    rows = line_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not differences(line_dedup.drop_recurring_lines(docs, count_col="n_dropped"), con, OP10)


def test_the_same_rows_without_broadcasts(spark, small, monkeypatch):
    """Tables too large to broadcast are joined by shuffles."""
    from riskloom.llm import queries, store

    names = ["op1_decontamination", "op3_ngram_join", "op9_substring_dedup", "op10_line_dedup"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = {n: sorted(map(repr, queries.QUERIES[n](spark, small).collect())) for n in names}
    monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in names:
            assert sorted(map(repr, queries.QUERIES[name](spark, small).collect())) == seen[name], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_short_sets_cost_what_they_share():
    """100,000 sets of three n-grams, one of them shared by ten sets each."""
    import time

    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**62, (100_000, 2)).astype(np.uint64)
    common = np.repeat(rng.integers(0, 2**62, 10_000).astype(np.uint64), 10)
    sets = [np.unique(np.r_[a, c]) for a, c in zip(own, common)]
    sets[500] = sets[99_500] = np.unique(np.r_[own[500], own[99_500]])
    begin = time.process_time()
    assert ngram_join.forest(np.arange(len(sets)), sets) == [(500, 99_500)]
    assert time.process_time() - begin < 60


def test_sizes_follow_the_values(spark):
    from riskloom.llm import store

    rows = spark.range(1000).selectExpr("id", "repeat('x', 500) AS text", "array(1, 2, 3) AS list")
    assert 500_000 < store.size_of(rows.select("text")) < 600_000
    assert store.size_of(rows.select("id")) < 50_000 < store.size_of(rows.select("id", "list"))
    assert store.size_of(rows.limit(0)) == 0


@pytest.mark.parametrize("operator", [ngram_join.one_of_each, line_dedup.drop_recurring_lines, substring_dedup.without_passages])
def test_other_columns_stay(spark, operator):
    clashing = table(spark, [(1, "a b c"), (2, None)]).selectExpr("*", *[f"5 AS `{p}{c}`" for p in ("", "_", "__") for c in ("cut", "cuts", "_doc", "_id")])
    assert [tuple(r) for r in operator(clashing).orderBy("doc_id").collect()] == [tuple(r) for r in clashing.orderBy("doc_id").collect()]
    rows = operator(table(spark, [(1, "a b c"), (2, None)])).collect()
    assert sorted((r.doc_id, r.text, r.doc, r.id) for r in rows) == [(1, "a b c", "x", "x"), (2, None, "x", "x")]


def test_sizes_that_forbid_a_link_give_none_by_what_is_shown():
    short, long = np.arange(3, dtype=np.uint64), np.arange(41, dtype=np.uint64)
    assert ngram_join.forest(np.array([1, 2]), [short, long], np.array([10, 200]), only_shown=True) == []
    assert ngram_join.forest(np.array([1, 2]), [long, long[2:]], np.array([200, 198]), only_shown=True) == [(2, 1)]


def test_texts_with_a_common_passage_do_not_meet(spark):
    rng = random.Random(2)
    passage = words(rng, 60, 10**6)
    rows = [(i, " ".join(passage + words(rng, 90, 10**6))) for i in range(60)]
    # A pair of near copies, and two texts of very different sizes with a passage of their own.
    rows += [(100, rows[0][1] + " and more"), (200, " ".join(pair := words(rng, 40, 10**6))), (201, " ".join(pair + words(rng, 300, 10**6)))]
    reps = spark.createDataFrame(rows, "id long, text string")
    common = spark.sparkContext.broadcast(ngram_join._common_ngrams(reps, 10_000, 4))
    met = ngram_join._meetings(ngram_join._shared(ngram_join._shown_ngrams(reps, 4, common)), 85).distinct().collect()
    assert sorted(tuple(r) for r in met) == [(0, 0), (100, 0)]
    found = {r.id: (r.n, r.component) for r in ngram_join.similar_components(table(spark, rows)).collect()}
    assert found == brute.near_copies(rows)


def test_the_order_of_shown_ngrams_keeps_common_ones_last():
    ngrams = np.arange(10, 20, dtype=np.uint64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    assert ngram_join.first_shown(ngrams, none).tolist() == [10, 11, 12]
    assert ngram_join.first_shown(ngrams, (np.array([10, 12], np.uint64), np.array([1, 0], np.int32))).tolist() == [11, 13, 14]
    all_but_one = np.arange(11, 20, dtype=np.uint64), np.arange(9, dtype=np.int32)[::-1].copy()
    assert ngram_join.first_shown(ngrams, all_but_one).tolist() == [10, 19, 18]


@pytest.mark.parametrize("only_shown", [False, True])
def test_forests_join_what_all_pairs_join(only_shown):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 3000, rng.integers(4, 60))
        for _ in range(rng.integers(1, 6)):
            sets.append(np.unique(np.r_[base, rng.integers(0, 40, 3)][rng.integers(0, 3) :]).astype(np.uint64))
    sizes = np.array([len(s) * (5 if only_shown else 1) - (4 if only_shown else 0) for s in sets])
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if len(np.intersect1d(sets[i], sets[j])) >= ngram_join.needed_overlaps(int(sizes[i]), sizes[j : j + 1], 85, only_shown)[0]
        and ngram_join.least_overlap(int(sizes[i]), int(sizes[j])) <= min(sizes[i], sizes[j])
    ]

    def families(pairs):
        parent = list(range(len(sets)))
        for a, b in pairs:
            a, b = (next(iter(r for r in [parent[x]])) for x in (a, b))
            parent = [min(a, b) if p in (a, b) else p for p in parent]
        return parent

    found = ngram_join.forest(np.arange(len(sets)), sets, sizes, only_shown=only_shown)
    assert links and families(found) == families(links)
    assert len(found) == len(sets) - len(set(families(links)))


def test_shuffles_and_rows_for_now_leave_the_disk(spark):
    import os
    import time
    from urllib.parse import urlparse

    from riskloom.llm import store

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = files.getAllFiles().size(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting, "false")
    with store.written_for_now(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()) as rows:
        assert len(rows.collect()) == 5000
        folder = os.path.dirname(urlparse(rows.inputFiles()[0]).path)
    assert not os.path.exists(folder) and spark.conf.get(setting, "false") == kept
    until = time.time() + 20
    while files.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.2)
    assert files.getAllFiles().size() <= before
