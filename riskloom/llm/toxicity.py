"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is cut into segments of a few words. A segment's bag holds the character
n-grams of its words (with their borders); the n-grams' vectors are averaged and
a linear softmax gives its probability. Vectors and softmax are trained together
in numpy. A label belongs to a whole text: after a first phase in which all its
segments carry the label, only the segments a toxic text is most suspected for
stay positive, and a text's score is that of its most toxic segment. Misspelt
and unseen words share n-grams with known ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.llm import store

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 8
SEGMENT_WORDS = 6
POSITIVE_ROWS = 800
NEGATIVE_ROWS = 1600
# Segments of one text that training sees at most, drawn by hash from all of its words.
TEXT_SEGMENTS = 600
EPOCHS = 18
BATCH = 4096
# Few segments get more epochs, so that there are so many steps at least.
STEPS = 240
WARM_SHARE = 0.2
TOXIC_FROM = 0.5

_STEP = np.uint64(0x100000001B3)
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def segment_ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, segment) of every n-gram of the whole lower-cased text; empty without words.

    N-grams are runs of bytes of one word, its border counted as a space.
    """
    data = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    space = _SPACE[data]
    data = np.where(space, np.uint8(32), data)
    n = len(data)
    opens = ~space
    opens[1:] &= space[:-1]
    word = np.cumsum(opens, dtype=np.int32) - 1
    spaces = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=spaces[1:])
    values = data.astype(np.uint64)
    rolling, buckets, segments = values.copy(), [], []
    for size in range(2, max(SIZES) + 1):
        if n < size:
            break
        rolling = rolling[: n - size + 1] * _STEP + values[size - 1 :]
        if size in SIZES:
            inner = spaces[size - 1 : n] - spaces[1 : n - size + 2]  # spaces between first and last byte
            at = np.flatnonzero(inner == 0)
            buckets.append(((rolling[at] + np.uint64(size)) * _SCRAMBLE >> np.uint64(64 - 17)).astype(np.int32))
            segments.append((word[at + 1] // SEGMENT_WORDS).astype(np.int32))
    if not buckets or word[-1] < 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(segments)


def drawn_segments(text: str, most: int) -> str:
    """The text, or of a longer one `most` of its segments, drawn by a hash of their places, in order."""
    words = text.split()
    if len(words) <= most * SEGMENT_WORDS:
        return text
    n = -(-len(words) // SEGMENT_WORDS)
    with np.errstate(over="ignore"):
        hashed = (np.arange(1, n + 1, dtype=np.uint64) * _SCRAMBLE) >> np.uint64(20)
    # A last segment of fewer words would shift the words of those behind it, so it stays last.
    chosen = np.sort(np.argsort(hashed, kind="stable")[:most])
    return " ".join(" ".join(words[SEGMENT_WORDS * i : SEGMENT_WORDS * (i + 1)]) for i in chosen)


@dataclass
class ToxicityModel:
    """The logit that each n-gram adds to the average of its segment, and the bias."""

    weights: np.ndarray
    bias: float

    def logit(self, text: str | None) -> float:
        buckets, segments = segment_ngrams(text)
        if not len(buckets):
            return -np.inf
        counts = np.bincount(segments)
        sums = np.bincount(segments, weights=self.weights[buckets])
        return float((sums[counts > 0] / counts[counts > 0]).max()) + self.bias

    def score(self, text: str | None) -> float:
        """The toxic probability of the most toxic segment; 0 for a text without words."""
        logit = self.logit(text)
        return 0.0 if logit == -np.inf else float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


class _Bags:
    """All segments of the training texts, n-grams side by side."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        parts, owners, label, at = [], [], [], 0
        lengths = []
        for doc, (text, y) in enumerate(zip(texts, labels)):
            buckets, segments = segment_ngrams(text)
            if not len(buckets):
                continue
            order = np.argsort(segments, kind="stable")
            counts = np.bincount(segments)
            parts.append(buckets[order])
            lengths.append(counts[counts > 0])
            owners.append(np.full(int((counts > 0).sum()), doc))
            label.append(np.full(int((counts > 0).sum()), y))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.docs = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.labels = np.concatenate(label) if label else np.zeros(0)


def train(texts: list[str], labels: list[int], seed: int = 7) -> ToxicityModel | None:
    """Train on whole texts with 0/1 labels; None unless both labels occur.

    Embeddings and softmax move together by Adagrad over batches of segments.
    """
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    texts, y = [texts[i] for i in order], np.array([labels[i] for i in order])
    bags = _Bags(texts, y)
    if len(set(bags.labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.05).astype(np.float32)
    soft = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    memory = [np.full_like(vectors, 1e-6), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)]
    n = len(bags.lengths)
    target, weight = bags.labels.astype(np.int64), np.ones(n, np.float32)
    epochs = max(EPOCHS, -(-STEPS // -(-n // BATCH)))
    for epoch in range(epochs):
        if epoch >= WARM_SHARE * epochs:
            scores = _segment_logits(bags, vectors @ (soft[:, 1] - soft[:, 0])) + bias[1] - bias[0]
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, bags.docs, scores)
            suspected = scores >= top[bags.docs]
            weight = np.where(bags.labels == 1, suspected, 1).astype(np.float32)
        used = np.flatnonzero(weight > 0)
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            _step(bags, np.sort(used[at : at + BATCH]), target, weight, vectors, soft, bias, memory)
    return ToxicityModel(vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def _segment_logits(bags: _Bags, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[bags.ids], bags.starts[:-1]) / bags.lengths


def _step(bags, rows, target, weight, vectors, soft, bias, memory, rate: float = 0.3) -> None:
    lengths = bags.lengths[rows]
    starts = np.r_[0, np.cumsum(lengths)]
    ids = bags.ids[np.arange(starts[-1]) + np.repeat(bags.starts[rows] - starts[:-1], lengths)]
    mean = np.add.reduceat(vectors[ids], starts[:-1], axis=0) / lengths[:, None]
    logits = mean @ soft + bias
    logits -= logits.max(1, keepdims=True)
    error = np.exp(logits)
    error /= error.sum(1, keepdims=True)
    error[np.arange(len(rows)), target[rows]] -= 1
    error *= (weight[rows] / max(1.0, float(weight[rows].sum())))[:, None]
    back = (error @ soft.T / lengths[:, None]).astype(np.float32)
    spread = np.repeat(back, lengths, axis=0)
    grads = [
        np.stack([np.bincount(ids, weights=spread[:, d], minlength=BUCKETS) for d in range(DIMENSIONS)], 1),
        mean.T @ error, error.sum(0),
    ]
    for value, grad, seen in zip((vectors, soft, bias), grads, memory):
        seen += (grad * grad).astype(np.float32)
        value -= (rate * grad / np.sqrt(seen)).astype(np.float32) * (grad != 0)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    positives: int = POSITIVE_ROWS, negatives: int = NEGATIVE_ROWS, segments: int = TEXT_SEGMENTS,
) -> ToxicityModel | None:
    """Learn from a bounded sample of labelled rows: of each class the given number with the
    smallest md5 of the id, whatever the length of the text. Of a text of more than `segments`
    segments so many are drawn, from all of its words.

    Only these segments, at most (positives + negatives) * segments, reach the
    driver. None unless both classes occur.
    """
    known = (
        store.named(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)")
        .groupBy("id").agg(F.max("label").cast("int").alias("label"))
    )
    texts = store.named(docs, id=id_col, text=text_col).where("text != ''")

    @F.pandas_udf("string")
    def drawn(batch: pd.Series) -> pd.Series:
        return pd.Series([drawn_segments(t, segments) for t in batch], dtype=object)

    # Only ids travel until the sample is chosen; its texts meet a broadcast of that many rows.
    labelled = texts.select("id").join(known, "id")
    rows = []
    for label, most in ((1, positives), (0, negatives)):
        order = F.md5(F.col("id").cast("string"))
        chosen = store.written(labelled.where(F.col("label") == label).select("id").distinct().orderBy(order, "id").limit(most))
        own = texts.join(F.broadcast(chosen), "id").select("id", drawn(F.col("text").cast("string")).alias("text"))
        own = own.orderBy(order, "id", F.xxhash64("text")).limit(most)
        rows += own.withColumn("label", F.lit(label)).collect()
    return train([r.text for r in rows], [r.label for r in rows])


def with_score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns with the score of their whole text; no shuffle.

    Nulls and texts without words score 0, and without a model every row does. A
    column already named like the score is replaced.
    """
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return store.bounded_batches(docs).withColumn(score_col, score(F.col(f"`{text_col}`").cast("string")))
