"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its pairs of neighbouring byte kinds and three terms for how
much of it repeats. Terms are weighted by their document frequency over the
whole corpus. The labelled texts of the fit give the latent space (a truncated
SVD); their vectors are broadcast, every document is compared with all of them
by exact cosine products in blocks, and its nearest neighbours vote with their
similarity, weighted by how many labelled rows each stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.llm import store
from riskloom.llm.bytes_np import word_hashes

KINDS = 64
TERMS = KINDS * KINDS + 3
PER_CLASS = 1500
DIMENSIONS = 64
NEIGHBOURS = 15
BLOCK = 512
SHARPNESS = 8.0
KEEP_FROM = 0.7


def _kinds() -> np.ndarray:
    """Letters, capitals, digits, white space, marks and the lead bytes of other letters."""
    kind = np.full(256, 1, np.int64)
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[32]] = 4
    kind[[9, 10, 11, 12, 13]] = 5
    kind[ord("a") : ord("z") + 1] = np.arange(6, 32)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    kind[marks] = 32 + np.arange(len(marks)) % 28
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:] = 60, 61, 62, 63
    return kind


_KIND = _kinds()
_FIRST = _KIND * KINDS


_THREE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _repeated(values: np.ndarray) -> float:
    """The share of values that an earlier place of the text already has."""
    if len(values) < 2:
        return 0.0
    ordered = np.sort(values)
    return np.count_nonzero(ordered[1:] == ordered[:-1]) / len(values)


def term_weights(text: str | None) -> np.ndarray:
    """The unweighted term vector of one whole text; a null or empty one has none."""
    out = np.zeros(TERMS, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    pairs = np.bincount(_FIRST[data[:-1]] + _KIND[data[1:]], minlength=KINDS * KINDS)
    out[: KINDS * KINDS] = np.sqrt(pairs / max(1, len(raw) - 1))
    words = word_hashes(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[-3] = _repeated(words) ** 2 if len(words) >= 20 else 0
    out[-2] = _repeated(words[:-2] * _THREE[0] + words[1:-1] * _THREE[1] + words[2:] * _THREE[2])
    out[-1] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


@dataclass
class QualityModel:
    """What the executors need: one row of `vectors`, `labels`, `stands_for` per labelled text."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        weighted = terms * self.idf
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
        latent = weighted @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The similarity-weighted share of label 1 among each text's nearest neighbours.

        Ties in similarity go to the earlier labelled row. A text without any
        similar neighbour (an empty one) gets the share among all labelled rows.
        """
        prior = float((self.labels * self.stands_for).sum() / self.stands_for.sum())
        out = np.full(len(texts), prior)
        for at in range(0, len(texts), BLOCK):
            terms = np.stack([term_weights(t) for t in texts[at : at + BLOCK]])
            cosines = self.project(terms) @ self.vectors.T
            k = min(neighbours, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** SHARPNESS * self.stands_for[near]
            total = weight.sum(1)
            share = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-30)
            out[at : at + BLOCK] = np.where(total > 1e-30, share, out[at : at + BLOCK])
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all documents; and their number.

    Every task sends one row of TERMS counts for its documents.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found += term_weights(text) > 0
            n += len(batch)
        yield pd.DataFrame({"n": [n], "counts": [found.tolist()]})

    partial = store.named(docs, text=text_col).mapInPandas(count, "n long, counts array<long>")
    rows = (
        partial.select(F.posexplode(F.concat(F.array("n"), "counts")).alias("term", "n"))
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    )
    totals = np.zeros(TERMS + 1, np.int64)
    for row in rows:
        totals[row.term] = row.n
    return totals[1:], int(totals[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int):
    """At most `per_class` labelled rows of each class, smallest md5 of the id first, with
    their texts' term vectors; and how many labelled rows each class has."""
    known = (
        store.named(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)")
        .groupBy("id").agg(F.max("label").cast("int").alias("label"))
    )
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.md5(F.col("id").cast("string"))
    chosen = None
    for label in sorted(totals):
        part = known.where(F.col("label") == label).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return [], totals
    texts = store.named(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [term_weights(t) for t in batch["text"]]
            at = [np.flatnonzero(t) for t in terms]
            yield pd.DataFrame({
                "id": batch["id"], "label": batch["label"], "at": [a.astype("<i4").tobytes() for a in at],
                "weight": [t[a].astype("<f4").tobytes() for t, a in zip(terms, at)],
            })

    # One vector per labelled id, however many rows repeat it.
    first = F.min(F.struct("at", "weight", "label")).alias("r")
    rows = texts.mapInPandas(vectors, "id long, label int, at binary, weight binary").groupBy("id").agg(first).select("id", "r.*")
    return sorted(rows.collect(), key=lambda r: r.id), totals


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", per_class: int = PER_CLASS, dimensions: int = DIMENSIONS,
) -> QualityModel | None:
    """Learn from a bounded sample of labelled rows (`per_class` of each class) and from
    the document frequencies of the whole corpus. None without any labelled text."""
    rows, totals = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    if not rows:
        return None
    counts, n = document_frequencies(docs, text_col)
    idf = (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)
    weighted = np.zeros((len(rows), TERMS), np.float32)
    for i, row in enumerate(rows):
        weighted[i, np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["weight"], "<f4")
    weighted *= idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    axes = leading_axes(weighted, dimensions)
    y = np.array([r.label for r in rows], np.float32)
    sampled = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    stands_for = np.array([totals[r.label] / sampled[r.label] for r in rows], np.float32)
    latent = weighted @ axes
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return QualityModel(idf, axes, latent, y, stands_for)


def leading_axes(rows: np.ndarray, dimensions: int, passes: int = 6) -> np.ndarray:
    """The leading right singular vectors as columns; fewer where the rows span less.

    A random basis is multiplied by the rows and back a few times; the axes are then
    found in its span. No product of all rows with each other is made.
    """
    width = min(*rows.shape, 2 * dimensions)
    basis = np.random.default_rng(5).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(passes):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, values, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    keep = values[:dimensions] > 1e-4 * max(values[0], 1e-12)
    return basis @ turned[: len(keep)][keep].T


def with_score(docs: DataFrame, model: QualityModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns with the score of their whole text; no shuffle.

    Nulls and empty texts get the labelled rows' share of label 1, and without a
    model every score is 0.5. A column already named like the score is replaced.
    """
    if model is None:
        return docs.withColumn(score_col, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return store.bounded_batches(docs).withColumn(score_col, score(F.col(f"`{text_col}`").cast("string")))
