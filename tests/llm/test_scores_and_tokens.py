"""Sharding, classifiers, rules, token files and SentencePiece."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from riskloom.llm import quality_classifier, quality_rules, queries, sentence_pieces, sharding, store, token_files, toxicity
from tests.llm import brute

ODD = [
    None, "", " ", "\n\n", "Straße İSTANBUL ΟΔΟΣ ΟΔΟΣ. a", "café x", "<|endoftext|> a <|STARTOFTEXT|>", "tab\tnl\r\nb\x85c d  e",
    "it's don't 12a.b ... word.,. !!", "K Å ǅ ﬁ ½²", "a\x1cb 中文字 emoji😀😀.", " two  spaces ", "word " * 3000, "x" * 5000,
]
WORDS, PIECES = queries.tokenizer_file(queries.WORD_TOKENIZER), queries.tokenizer_file(queries.PIECE_MODEL)


def odd_table(spark):
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(ODD)] + [(3, "again", "a", "b", "c"), (None, "no id", "a", "b", "c"), (3, "again", "a", "b", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, ids string, shard string")


def texts_of(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


def test_shards_are_even_and_stable(spark):
    owners = sharding.lookup_table(sharding.SHARDS)
    counts = np.bincount(owners)
    assert counts.max() - counts.min() <= 1 and len(counts) == len(sharding.SHARDS)
    fewer = sharding.SHARDS[:-1]
    moved = sharding.moved_slots(spark, sharding.SHARDS, fewer).count()
    assert moved < 0.25 * sharding.TABLE_SIZE
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_placing_odd_rows(spark):
    placed = sharding.place(odd_table(spark), "doc_id")
    assert placed.columns == ["doc_id", "text", "score", "ids", "slot", "shard"]
    rows = placed.collect()
    assert len(rows) == len(ODD) + 3 and all(r.shard for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 3}) == 1
    assert sharding.place(odd_table(spark).limit(0), "doc_id").count() == 0
    clashing = odd_table(spark).selectExpr("*", "5 AS key_slot", "6 AS `_key_slot`", "7 AS slot", "8 AS `_slot`", "9 AS `__shard`")
    found = sharding.place(clashing, "doc_id")
    assert {*found.columns} == {*clashing.columns, "shard"} and len(found.columns) == len({*found.columns})
    assert found.where("key_slot != 5 or `_key_slot` != 6 or `_slot` != 8 or `__shard` != 9").count() == 0


@pytest.mark.parametrize("name, label, held", [("op5_quality", "quality", 0.97), ("op6_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, data, name, label, held):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{data}/labels.parquet'").fetchall())
    rows = queries.QUERIES[name](spark, data).collect()
    assert len(rows) == len(texts_of(data)) and all(0 <= r.score <= 1 for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and np.mean([p == t for p, t in judged]) >= held


def test_scores_of_odd_texts(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8, 14)] + [(None, 1, 1), (9, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for module, fitted in ((quality_classifier, quality_classifier.fit(docs, labels)), (toxicity, toxicity.fit(docs, labels))):
        for model in (fitted, None):
            scored = module.with_score(docs, model)
            rows = scored.collect()
            assert scored.columns == docs.columns and len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows)
            assert module.with_score(docs.limit(0), model).count() == 0
        assert module.fit(docs, labels.limit(0)) is None


def test_neighbours_by_brute_force(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality_classifier.fit(spark.read.parquet(f"{small}/documents.parquet"), labels)
    for _, text in texts_of(small)[:40]:
        vector = model.project(quality_classifier.term_weights(text)[None])[0]
        cosines = model.vectors @ vector
        near = np.argsort(-cosines, kind="stable")[: quality_classifier.NEIGHBOURS]
        weight = np.maximum(cosines[near], 0) ** quality_classifier.SHARPNESS * model.stands_for[near]
        assert abs(model.score([text])[0] - (weight * model.labels[near]).sum() / weight.sum()) < 0.02


def test_misspelt_words_share_ngrams():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    plain = [" ".join(word() for _ in range(40)) for _ in range(200)]
    toxic = [f"{t} {bad} {t}" for t, bad in zip(plain, ["zlooper", "qwizard"] * 50)]
    model = toxicity.train(toxic + plain, [1] * 100 + [0] * 200)
    clean = max(model.score(" ".join(word() for _ in range(4))) for _ in range(50))
    assert min(model.score("abcd zlooperz efgh"), model.score("abcd qwizzard efgh")) > max(clean, 0.5)
    assert model.score(None) == model.score(" \n") == 0.0
    assert toxicity.train(plain, [0] * 200) is None


def test_measures_by_brute_force(spark, small):
    rows = texts_of(small) + list(enumerate(ODD, 10**6)) + [(10**7, "a b c a b c\n\n a\na\n#*x é")]
    assert all(quality_rules.measure(t)[:5] == brute.measures(t) for _, t in rows)


def test_rules_on_odd_rows(spark):
    judged = quality_rules.judge(odd_table(spark)).collect()
    assert len(judged) == len(ODD) + 3
    for r in judged:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= quality_rules.KEEP_FROM)
    assert quality_rules.judge(odd_table(spark).limit(0)).count() == 0


def test_label_model_finds_good_and_bad_rules():
    rng = random.Random(3)
    right = [0.95, 0.9, 0.85, 0.6]
    patterns, truth = [], []
    for _ in range(3000):
        good = rng.random() < 0.8
        patterns.append("".join("-" if rng.random() < 0.2 else "gb"[(rng.random() < p) != good] for p in right))
        truth.append(good)
    model = quality_rules.fit_patterns(patterns, [1] * len(patterns))
    assert abs(model.good - 0.8) < 0.05
    assert np.mean((model.posterior(patterns) >= 0.5) == np.array(truth)) > 0.93
    accuracy = model.chances[1, :, 2] / (model.chances[1, :, 2] + model.chances[1, :, 0])
    assert accuracy[0] > accuracy[3]


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_give_back_every_id(spark, tmp_path):
    docs = odd_table(spark)
    token_files.write_tokens(docs, f"{tmp_path}/tokens", WORDS, 1, segment_tokens=500, partitions=3)
    rows = token_files.read_tokens(spark, f"{tmp_path}/tokens", "ids_crc32 long, ids array<long>", lambda x: (*token_files.crc_of(x), x.tolist())).orderBy("start").collect()
    wanted = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert sorted(r.id for r in rows if r.id is not None) == [w[1] for w in wanted if w[0]]
    assert [r.id for r in rows] == sorted((r.id for r in rows), key=lambda i: (i is not None, i or 0))
    by_id = {}
    for (_, i, text), ids in zip(wanted, library_ids([w[2] for w in wanted])):
        by_id.setdefault(i, []).append([*ids, 1])
    start = 0
    for r in rows:
        assert r.start == start and list(r.ids) in by_id[r.id or 0] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    stored = spark.read.schema(token_files.SEGMENT).parquet(f"{tmp_path}/tokens").collect()
    one = max(stored, key=lambda s: s.n_tokens)
    flat = token_files.Levels.of(one.levels).get(np.arange(one.n_tokens))
    assert token_files.token_at(spark, f"{tmp_path}/tokens", one.part, one.segment, 7) == flat[7]


def test_token_query_as_the_library(spark, small):
    rows = texts_of(small)
    found = {r.doc_id: r for r in queries.op4_token_files(spark, small).collect()}
    start = 0
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    folder = store.shared_folder(spark)
    token_files.write_tokens(empty, folder, WORDS, 1)
    assert token_files.read_tokens(spark, folder, "ids_crc32 long", token_files.crc_of).count() == 0


@pytest.mark.parametrize("high", [1, 256, 257, 49408, 2**20, 2**32])
def test_levels_at_random_places(high):
    ids = np.random.default_rng(high).integers(0, high, 5000).astype(np.uint32)
    ids[:700] = 0
    levels = token_files.Levels.of(token_files.encode_levels(ids))
    assert np.array_equal(levels.get(np.arange(5000)), ids)
    places = np.array([4999, 0, 511, 512, 513, 3, 3])
    assert np.array_equal(levels.get(places), ids[places])


def test_any_tokenizer_file_gives_its_own_ids(tmp_path, small):
    """A file that parts texts in another way gets whole texts."""
    import json

    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as file:
        stored = json.load(file)
    stored["normalizer"] = {"type": "NFC"}
    stored["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(stored, file)
    assert token_files.WordEncoder(WORDS).known and not token_files.WordEncoder(path).known
    texts, library = [t or "" for _, t in texts_of(small)[:30]], Tokenizer.from_file(path)
    assert [list(x) for x in token_files.WordEncoder(path).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_of_words_may_overflow(monkeypatch, small):
    monkeypatch.setattr(token_files, "PIECE_BYTES", 50 * 200)
    texts = [t for _, t in texts_of(small)[:30]]
    assert [list(x) for x in token_files.WordEncoder(WORDS).encode(texts)] == library_ids(texts)


def test_streaming_path_is_the_best_path(small):
    codec = sentence_pieces.PieceCodec(PIECES, word_bytes=500 * 200, run_bytes=500 * 200)
    for text in [t for _, t in texts_of(small)[:40]] + ODD:
        ids = codec.encode(text)
        assert ids.tolist() == brute.best_path(codec.v, text)
        assert codec.decode(ids) == (text or "")


def test_long_texts_give_some_of_all_their_segments():
    words = [f"w{i}" for i in range(3001)]
    text, size = " ".join(words), toxicity.SEGMENT_WORDS
    assert toxicity.drawn_segments(text, 600) == text and toxicity.drawn_segments("", 1) == ""
    drawn = toxicity.drawn_segments(text, 50).split()
    starts = [int(w[1:]) for w in drawn[::size]]
    assert len(starts) == 50 == len(set(starts)) and all(s % size == 0 for s in starts) and starts == sorted(starts)
    assert min(starts) < 300 and max(starts) > 2700
    assert drawn == [w for s in starts for w in words[s : s + size]]


def test_short_texts_as_the_stream_takes_them(small):
    v = sentence_pieces.Vocabulary(PIECES)
    rng = random.Random(2)
    words = {w for _, t in texts_of(small)[:60] for w in (t or "").split()} | {"".join(rng.choice("abe▁é日x#1") for _ in range(n)) for n in range(1, 30) for _ in range(20)}
    for word in sorted(words)[:4000]:
        stream = sentence_pieces.StreamingViterbi(v)
        assert sentence_pieces.window_path(v, word) == stream.feed(word) + stream.close()


def test_window_stays_bounded():
    codec = sentence_pieces.PieceCodec(PIECES)
    stream, ids = sentence_pieces.StreamingViterbi(codec.v), []
    text = "▁" + "abcdeéfg" * 400
    for char in text:
        ids += stream.feed(char)
        assert len(stream.window) <= 4 * codec.v.longest
    assert ids + stream.close() == brute.best_path(codec.v, text[1:])


def test_the_library_finds_no_better_path(small):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = sentence_pieces.PieceCodec(PIECES)
    total = lambda ids: sum(codec.v.scores.get(codec.v.pieces[int(i)], 0.0) for i in ids)
    lines = [x for _, t in texts_of(small)[:60] for x in (t or "").split("\n") if x and "  " not in x]
    known = [x for x in lines if not set(x) - set(codec.v.ids) - {" "}]
    assert len(known) > 100 and all(total(codec.encode(x)) >= total(library.encode(x)) for x in known)


def test_codec_columns(spark):
    encoded = sentence_pieces.with_ids(odd_table(spark), PIECES)
    decoded = sentence_pieces.with_text(encoded, PIECES, into="again").collect()
    assert encoded.columns == odd_table(spark).columns
    assert all(r.again == (r.text or "") for r in decoded)
    assert sentence_pieces.with_ids(odd_table(spark).limit(0), PIECES).count() == 0


def test_words_that_come_once_take_no_room():
    """op8: a flood of words that come once pushes no word out that comes again, also over generations."""
    from riskloom.llm.memo import Memo

    memo = Memo(190 * 60)
    for i in range(2000):
        for key in (f"once{i}", f"often{i % 20}"):
            if memo.get(key) is None:
                memo.put_again(key, b"ids of " + key.encode())
    assert all(memo.get(f"often{i}") == b"ids of often%d" % i for i in range(20))
    assert sum(k.startswith("once") for k in [*memo.young, *memo.old]) < 10
    for i in range(200):  # more words that come again than a generation holds: the cache goes on learning
        for _ in range(2):
            memo.put_again(f"later{i}", b"x")
    assert memo.get("later199") == b"x"


def test_words_are_followed_character_by_character():
    """op8: a search goes down a tree by single characters, no stretch of the word is cut out and looked up."""
    v = sentence_pieces.Vocabulary(PIECES)
    for start, score in v.beginnings.items():
        below = v.tree
        for char in start:
            found, piece, below = below[char]
        assert (found, piece) == ((score, v.ids[start]) if score is not None else (v.unknown if len(start) == 1 else float("-inf"), -1))
    known = list(v.ids.items())[-3:]
    expected = [sentence_pieces.window_path(v, "▁reoratth%日" + p) for p, _ in known]
    v.beginnings = v.scores = None
    assert [sentence_pieces.window_path(v, "▁reoratth%日" + p) for p, _ in known] == expected
