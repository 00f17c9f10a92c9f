"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts: how often each symbol followed each context of
up to ORDER bytes in all training texts. A symbol's probability comes from the
longest context that has seen it; every longer one costs its escape probability, and
symbols a longer context has seen are left out of the counts of a shorter one. With d
different symbols among t occurrences the escape is d / 2t, a symbol seen n times has
(2n - 1) / 2t. Behind the empty context all symbols not yet left out are equally likely.
A text is predicted from its first byte to its end, which is a symbol of its own.

The trie grows with the corpus and is nowhere whole. Texts are put in packs; a pack
sends its different contexts and symbols, with their counts, to buckets by the last
two bytes of the context, which hold all longer contexts with their shorter forms. A
bucket adds the counts up and sends back the probability of whatever a pack asked for.
Only the table of single bytes and their successors (at most 257 x 257 counts) is broadcast.
Word counts of the unigram score go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import bytes_np, store

ORDER = 5
SYMBOL_BITS = 9
BOUNDARY = 256  # before a text, and its end
SYMBOLS = 257
PACK_BYTES = 8 << 20
SLICE = 1 << 20
BUCKETS = 256
# Packs whose questions one task answers at most, for one bucket.
PACKS_AT_ONCE = 256
_GRAM, _WORD, _PAIR = "gram", "word", "pair"
_LOWER = bytes(range(256)).lower()
_COUNTED = "family string, bucket int, salt int, batch long, codes binary, counts binary"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: equal places side by side, compressed."""
    import zstandard

    columns = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(columns.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(columns.reshape(8, -1).T).view("<i8").ravel()


def packed_text(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked_text(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed_codes(codes: np.ndarray) -> bytes:
    """Ascending codes by their differences (modulo 2^64)."""
    return packed(np.diff(codes, prepend=np.int64(0)))


def unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.int64)


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in ascending order with the sums of their counts."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


class Counter:
    """Counts of codes, merged whenever as many have come together as there were different ones."""

    def __init__(self):
        self.codes, self.counts, self.waiting, self.kept = [], [], 0, 0

    def add(self, codes: np.ndarray, weight: int) -> None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        self.codes.append(codes[first])
        self.counts.append(np.diff(np.r_[first, len(codes)]) * weight)
        self.waiting += len(first)
        if self.waiting > self.kept + SLICE:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        code, count = merged(self.codes, self.counts)
        self.codes, self.counts, self.waiting, self.kept = [code], [count], 0, len(code)
        return code, count


def symbols(data: bytes, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a pack with `order` boundaries before each and behind the last; and where each text begins."""
    n = len(ends)
    lengths = np.diff(ends, prepend=0)
    starts = np.r_[0, ends[:-1]] + order * (np.arange(n) + 1)
    out = np.full(len(data) + order * (n + 1) + 1, BOUNDARY, np.uint16)
    source = np.frombuffer(data, np.uint8)
    inside = np.ones(len(out), bool)
    gaps = np.r_[0, starts + lengths][:, None] + np.arange(order)
    inside[gaps.ravel()] = False
    inside[-1] = False
    out[inside] = source
    return out, starts


def gram_codes(symbol: np.ndarray, begin: int, end: int, order: int) -> np.ndarray:
    """The code of context and symbol at the places from `begin` (at least `order`) to `end`."""
    code = np.zeros(end - begin, np.int64)
    for back in range(order, -1, -1):
        code <<= SYMBOL_BITS
        code |= symbol[begin - back : end - back]
    return code


def predicted(starts: np.ndarray, lengths: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places between `begin` and `end` belong to a text or are its end, and the text of each such place."""
    edges = np.zeros(end - begin + 1, np.int32)
    low, high = np.clip(starts, begin, end) - begin, np.clip(starts + lengths + 1, begin, end) - begin
    np.add.at(edges, low, 1)
    np.add.at(edges, high, -1)
    places = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    return places, np.searchsorted(starts, places + begin, side="right") - 1


def text_slices(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts that end at white space where they can."""
    whole, at = np.frombuffer(data, np.uint8), 0
    while at < len(whole):
        end = min(len(whole), at + SLICE)
        while end < len(whole):
            white = np.flatnonzero(bytes_np.WHITE[whole[at:end]])
            if len(white):
                end = at + int(white[-1]) + 1
                break
            end = min(len(whole), end + SLICE)
        yield at, whole[at:end]
        at = end


def words_of(data: bytes, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hashes, texts) of the words of a pack, A-Z folded to a-z. Texts end with white space."""
    for offset, part in text_slices(data.translate(_LOWER)):
        begins, stops = bytes_np.word_bounds(part)
        found = bytes_np.hashes(part, begins, stops).view(np.int64)
        yield found, np.searchsorted(ends, begins + offset, side="right")


def _packs(docs: DataFrame, learn: Column, id_col: str, text_col: str, pack_bytes: int) -> DataFrame:
    """Packs of whole texts, those to learn from first: batch, n_learn, ids, ends and all bytes, compressed."""
    schema = "batch long, n_learn long, ids array<string>, learn array<boolean>, ends binary, data binary"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = store.bounded_batches(docs).select(
        F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        batch, held, size = TaskContext.get().partitionId() << 33, [], 0

        def pack() -> pd.DataFrame:
            own = sorted(held, key=lambda r: not r[1])
            ends = np.cumsum([len(r[2]) for r in own], dtype=np.int64)
            return pd.DataFrame({
                "batch": [batch], "n_learn": [sum(bool(r[1]) for r in own)], "ids": [[r[0] for r in own]], "learn": [[bool(r[1]) for r in own]],
                "ends": [ends.astype("<i8").tobytes()], "data": [packed_text(b"".join(r[2] for r in own))],
            })

        for piece in store.pieces(batches):
            for row in zip(piece["id"], piece["learn"], piece["text"]):
                held.append(row)
                size += len(row[2])
                if size >= pack_bytes:
                    yield pack()
                    batch, held, size = batch + 1, [], 0
        if held:
            yield pack()

    return rows.mapInPandas(run, schema)


def _by_bucket(family: str, codes: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[dict]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        yield {"family": family, "bucket": int(b), "codes": packed_codes(codes[own]), "counts": packed(counts[own])}


def _gram_buckets(codes: np.ndarray) -> np.ndarray:
    pair = (codes >> SYMBOL_BITS) & ((1 << 2 * SYMBOL_BITS) - 1)
    return (bytes_np.mix(pair.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _word_buckets(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def _count(packs: DataFrame, salts: int, order: int) -> DataFrame:
    """The different grams and words of every pack by bucket, with their counts in texts to learn from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ends, data = np.frombuffer(row.ends, "<i8"), unpacked_text(row.data)
                symbol, starts = symbols(data, ends, order)
                lengths, learns = np.diff(ends, prepend=0), np.asarray(row.learn, bool)
                grams, pairs, words = Counter(), Counter(), Counter()
                for begin in range(order, len(symbol) - 1, SLICE):
                    end = min(begin + SLICE, len(symbol) - 1)
                    places, owner = predicted(starts, lengths, begin, end)
                    codes, known = gram_codes(symbol, begin, end, order)[places], learns[owner]
                    grams.add(codes[known], 1)
                    grams.add(codes[~known], 0)
                    pairs.add(codes[known] & ((1 << 2 * SYMBOL_BITS) - 1), 1)
                for found, owner in words_of(*_spaced(data, ends)):
                    known = learns[owner]
                    words.add(found[known], 1)
                    words.add(found[~known], 0)
                rows = [{"family": _PAIR, "bucket": 0, "codes": packed_codes(pairs.close()[0]), "counts": packed(pairs.close()[1])}]
                for family, counter, buckets in ((_GRAM, grams, _gram_buckets), (_WORD, words, _word_buckets)):
                    codes, counts = counter.close()
                    rows += _by_bucket(family, codes, counts, buckets(codes))
                salt = int(bytes_np.mix(np.array([row.batch], np.uint64))[0] % np.uint64(salts))
                yield pd.DataFrame(rows).assign(salt=salt, batch=row.batch)[["family", "bucket", "salt", "batch", "codes", "counts"]]

    return packs.select("batch", "learn", "ends", "data").mapInPandas(run, _COUNTED)


def _spaced(data: bytes, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a line end behind each, and where each then ends."""
    begins = np.r_[0, ends[:-1]]
    return b"".join(data[a:b] + b"\n" for a, b in zip(begins, ends)), ends + np.arange(1, len(ends) + 1)


def _merge(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    codes = [unpacked_codes(c) for c in rows["codes"]]
    counts = [unpacked(c) for c in rows["counts"]]
    seen = [c > 0 for c in counts]
    return merged([c[s] for c, s in zip(codes, seen)], [c[s] for c, s in zip(counts, seen)])


def _model(counted: DataFrame) -> DataFrame:
    """The counts of every bucket over all packs, added up in two steps."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        codes, counts = _merge(rows)
        return pd.DataFrame({
            "family": [rows["family"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "total": [int(counts.sum())], "different": [len(codes)],
            "codes": [packed_codes(codes)], "counts": [packed(counts)],
        })

    schema = "family string, bucket int, total long, different long, codes binary, counts binary"
    columns = ["family", "bucket", "codes", "counts"]
    partial = counted.select("salt", *columns).groupBy("family", "bucket", "salt").applyInPandas(add, schema)
    return partial.select(columns).groupBy("family", "bucket").applyInPandas(add, schema)


class Trie:
    """Counts of contexts and symbols of all orders that a bucket holds; `pairs` has order 1."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], order: int):
        self.order = order
        grams, self.levels = {order: (codes, counts)}, {}
        for k in range(order - 1, 1, -1):
            grams[k] = self._shorter(*grams[k + 1], k)
        if order >= 1:
            grams[1] = pairs
        grams[0] = self._shorter(*pairs, 0)
        for k in range(order + 1):
            code, count = grams[k]
            context = code >> SYMBOL_BITS
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(code) else np.zeros(0, np.int64)
            total = np.add.reduceat(count, first) if len(first) else count
            left_out = np.zeros(len(first), np.int64)
            if k and len(first):
                # What a shorter context counts of the symbols seen here.
                below, below_counts = grams[k - 1]
                at = np.searchsorted(below, code & self._mask(k - 1))
                left_out = np.add.reduceat(below_counts[at], first)
            self.levels[k] = (code, count, context[first], total, np.diff(np.r_[first, len(code)]), left_out)

    @staticmethod
    def _mask(order: int) -> int:
        return (1 << SYMBOL_BITS * (order + 1)) - 1

    def _shorter(self, codes: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        return merged([codes & self._mask(order), np.zeros(0, np.int64)], [counts, np.zeros(0, np.int64)])

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """The logarithm of each symbol's probability behind its context."""
        out, open_ = np.zeros(len(asked)), np.arange(len(asked))
        gone_total, gone_different = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for k in range(self.order, -1, -1):
            codes, counts, contexts, totals, differents, left_out = self.levels[k]
            gram = asked[open_] & self._mask(k)
            at, met = _find(contexts, gram >> SYMBOL_BITS)
            if not met.any():
                continue
            # What longer contexts have seen is left out here.
            total = np.where(met, totals[at], 0) - gone_total[open_]
            different = np.where(met, differents[at], 0) - gone_different[open_]
            place, seen = _find(codes, gram)
            use = met & (total > 0)
            factor = np.ones(len(open_))
            hit = use & seen
            factor[hit] = (2 * counts[place[hit]] - 1) / (2 * total[hit])
            miss = use & ~seen
            factor[miss] = different[miss] / (2 * total[miss])
            out[open_] += np.log10(factor)
            gone_total[open_] = np.where(met, left_out[at], 0)
            gone_different[open_] = np.where(met, differents[at], 0)
            open_ = open_[~seen]
        out[open_] -= np.log10(SYMBOLS - gone_different[open_])
        return out


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted among ascending values, and whether they are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def _answers(counted: DataFrame, model: DataFrame, pairs: tuple[np.ndarray, np.ndarray], salts: int, order: int) -> DataFrame:
    """batch, family, codes, values: logarithms (of float32) for grams, counts for words."""
    shared = counted.sparkSession.sparkContext.broadcast(pairs)
    schema = "batch long, family string, codes binary, values binary"

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        codes, counts = _merge(known)
        family = asked["family"].iloc[0]
        trie = Trie(codes, counts, shared.value, order) if family == _GRAM else None
        values = []
        for data in asked["codes"]:
            wanted = unpacked_codes(data)
            if trie:
                values.append(trie.log10(wanted).astype("<f4").tobytes())
            else:
                at, met = _find(codes, wanted)
                values.append(packed(np.where(met, counts[at], 0) if len(codes) else np.zeros(len(wanted), np.int64)))
        return pd.DataFrame({"batch": asked["batch"], "family": family, "codes": asked["codes"], "values": values})

    by = ["family", "bucket", "salt"]
    spread = model.where(F.col("family") != _PAIR).select("family", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "codes", "counts")
    asked = counted.where(F.col("family") != _PAIR).select(*by, "batch", "codes")
    return asked.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(answer, schema)


_SCORED = "id string, learn boolean, n_words long, n_known_words long, word_logs double, score double"


def _score(packs: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """The sums over every text of what the buckets answered for its pack."""

    def run(pack: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for row in pack.itertuples():
            ends, data = np.frombuffer(row.ends, "<i8"), unpacked_text(row.data)
            n, lengths = len(ends), np.diff(ends, prepend=0)
            grams, words = own[own["family"] == _GRAM], own[own["family"] == _WORD]
            codes, logs = _sorted(grams["codes"], [np.frombuffer(v, "<f4") for v in grams["values"]])
            hashes, counts = _sorted(words["codes"], [unpacked(v) for v in words["values"]])
            score, word_logs = np.zeros(n), np.zeros(n)
            n_words, n_known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            symbol, starts = symbols(data, ends, order)
            for begin in range(order, len(symbol) - 1, SLICE):
                end = min(begin + SLICE, len(symbol) - 1)
                places, owner = predicted(starts, lengths, begin, end)
                found = logs[np.searchsorted(codes, gram_codes(symbol, begin, end, order)[places])]
                score += np.bincount(owner, weights=found, minlength=n)
            for found, owner in words_of(*_spaced(data, ends)):
                count = counts[np.searchsorted(hashes, found)] if len(found) else np.zeros(0, np.int64)
                word_logs += np.bincount(owner, weights=np.log10(count + 1.0), minlength=n)
                n_words += np.bincount(owner, minlength=n)
                n_known += np.bincount(owner[count > 0], minlength=n)
            frames.append(pd.DataFrame({
                "id": pd.Series(list(row.ids), dtype=object), "learn": list(row.learn), "n_words": n_words, "n_known_words": n_known,
                "word_logs": word_logs, "score": score,
            }))
        return pd.concat(frames)

    return packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, _SCORED)


def _sorted(codes, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0)
    code, value = np.concatenate([unpacked_codes(c) for c in codes]), np.concatenate(values)
    order = np.argsort(code)
    return code[order], value[order]


def score(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """id_col, learnt, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from all rows for which `learn` is true (null: not). `score` is the
    logarithm to base 10 of a text's probability, its end included; `base_score` that of its words
    (A-Z folded) and one end token under unigram counts with one added to each. `n_known` tokens
    occur in training, which has `train_tokens`. A null text counts as empty: its end alone is
    predicted. Equal rows get equal scores, each its own row; an empty table gives none. Without rows
    to learn from all symbols are equally likely. Words are told apart by 64-bit hashes.
    Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    packs = store.written(_packs(docs, learn, id_col, text_col, pack_bytes), **{"parquet.block.size": str(32 << 20)})
    sizes = packs.agg(F.count("*").alias("packs"), F.sum("n_learn").alias("texts")).first()
    salts, texts = max(1, -(-sizes["packs"] // PACKS_AT_ONCE)), sizes["texts"] or 0
    counted = store.written(_count(packs, salts, order))
    model = store.written(_model(counted))
    # One row of at most 257 x 257 counts.
    pair_rows = model.where(F.col("family") == _PAIR).select("codes", "counts").collect()
    pairs = merged([unpacked_codes(r["codes"]) for r in pair_rows], [unpacked(r["counts"]) for r in pair_rows])
    words = model.where(F.col("family") == _WORD).agg(F.sum("total").alias("n"), F.sum("different").alias("v")).first()
    total, different = (words["n"] or 0) + texts, (words["v"] or 0) + (texts > 0)
    scored = _score(packs, _answers(counted, model, pairs, salts, order), order)
    n_tokens = F.col("n_words") + 1
    return scored.select(
        F.col("id").cast(kind).alias(id_col), F.col("learn").alias("learnt"), n_tokens.alias("n_tokens"),
        (F.col("n_known_words") + int(texts > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("word_logs") + float(np.log10(texts + 1)) - n_tokens * float(np.log10(total + different + 1))).alias("base_score"), "score",
    )
