"""Operator 11 against a plain trie."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import language_model, queries
from tests.llm.brute import folded_words

END = 256


class PlainTrie:
    """Prediction by partial matching symbol by symbol, with sets of left-out symbols."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.places(text):
                for k in range(order + 1):
                    self.seen[context[order - k :]][symbol] += 1

    def places(self, text):
        row = (END,) * self.order + tuple((text or "").encode()) + (END,)
        return [(row[i - self.order : i], row[i]) for i in range(self.order, len(row))]

    def probabilities(self, context):
        """The probability of every symbol behind a context."""
        out, rest, gone = {}, 1.0, set()
        for k in range(self.order, -1, -1):
            counts = {s: n for s, n in self.seen.get(context[self.order - k :], {}).items() if s not in gone}
            total = sum(counts.values())
            if total:
                for s, n in counts.items():
                    out[s] = rest * (2 * n - 1) / (2 * total)
                rest *= len(counts) / (2 * total)
                gone |= set(counts)
        others = [s for s in range(257) if s not in gone]
        return out | {s: rest / len(others) for s in others}

    def log10(self, text):
        return sum(math.log10(self.probabilities(context)[symbol]) for context, symbol in self.places(text))


def plain_unigram(rows, learn):
    """id -> (n_tokens, n_known, N, base_score) of (id, text) rows."""
    counts, ends = Counter(), 0
    for i, text in rows:
        if learn(i):
            counts.update(folded_words(text))
            ends += 1
    total, different = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for i, text in rows:
        found = [counts[w] for w in folded_words(text)] + [ends]
        out.append((i, len(found), sum(c > 0 for c in found), total, sum(math.log10((c + 1) / (total + different + 1)) for c in found)))
    return out


ODD = [None, "", "a", "\n\n", "ab ab ab", "é日本\U0001f600", "The the THE", "x" * 300, "tab\tand\x0bfeed", "", "a", "Never seen before!"]


def check(found, rows, learn, order):
    trie = PlainTrie([t for i, t in rows if learn(i)], order)
    want = sorted(((str(i), n, k, total, base), trie.log10(text)) for (i, text), (_, n, k, total, base) in zip(rows, plain_unigram(rows, learn)))
    got = sorted(((str(r[0]), r.n_tokens, r.n_known, r.train_tokens, r.base_score), r.score) for r in found)
    assert len(got) == len(want)
    for (facts, score), (own, plain) in zip(got, want):
        assert facts[:4] == own[:4]
        assert facts[4] == pytest.approx(own[4], rel=1e-9) and score == pytest.approx(plain, rel=1e-6)


@pytest.mark.parametrize("order,pack_bytes", [(1, 1), (2, 60), (5, 1 << 20)])
def test_trie_of_odd_texts(spark, order, pack_bytes):
    rows = [(i, ODD[i % len(ODD)]) for i in range(30)] + [(3, ODD[3])]
    table = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id int, text string, id string, learn boolean").repartition(3)
    found = language_model.score(table, F.col("doc_id") % 3 != 0, order=order, pack_bytes=pack_bytes).collect()
    check(found, rows, lambda i: i % 3 != 0, order)


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(None, "ab"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in language_model.score(table, F.lit(None).cast("boolean")).collect()}
    assert found[None].score == pytest.approx(-3 * math.log10(257)) and found[2].score == pytest.approx(-math.log10(257))
    assert found[None].train_tokens == found[None].n_known == 0 and found[None].base_score == 0
    assert language_model.score(table.limit(0), F.lit(True)).collect() == []


def test_probabilities_add_up():
    texts = ["abracadabra", "abra", "cab"]
    trie = PlainTrie(texts, 2)
    for context in [(END, END), (END, 97), (97, 98), (98, 114), (120, 120)]:
        assert sum(trie.probabilities(context).values()) == pytest.approx(1)


def test_op11_by_plain_version(spark, small, monkeypatch):
    # Slices that end within texts and words.
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_language_model(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in found)
    check(found, rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, language_model.ORDER)


def test_slices_of_a_pack(monkeypatch):
    texts = ["one two  three" * 40, "", "x" * 700, "é ü\n" * 50]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    whole = [language_model.words_of(*language_model._spaced(b"".join(data), ends))]
    want = [np.concatenate(x) for x in zip(*whole[0])]
    monkeypatch.setattr(language_model, "SLICE", 64)
    got = [np.concatenate(x) for x in zip(*language_model.words_of(*language_model._spaced(b"".join(data), ends)))]
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
    assert np.bincount(got[1], minlength=4).tolist() == [len(re.findall(r"\S+", t)) for t in texts]
    symbol, starts = language_model.symbols(b"".join(data), ends, 3)
    codes, owners = [], []
    for begin in range(3, len(symbol) - 1, 64):
        end = min(begin + 64, len(symbol) - 1)
        places, owner = language_model.predicted(starts, np.diff(ends, prepend=0), begin, end)
        codes += language_model.gram_codes(symbol, begin, end, 3)[places].tolist()
        owners += owner.tolist()
    assert np.bincount(owners).tolist() == [len(d) + 1 for d in data]
    trie = PlainTrie([], 3)
    plain = [sum(s << 9 * (3 - k) for k, s in enumerate((*context, symbol))) for t in texts for context, symbol in trie.places(t)]
    assert codes == plain


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.array([-(2**63), 0, 2**63 - 1]), np.sort(rng.integers(-(2**62), 2**62, 1000))):
        assert np.array_equal(language_model.unpacked(language_model.packed(values)), values)
        assert np.array_equal(language_model.unpacked_codes(language_model.packed_codes(values)), values)
