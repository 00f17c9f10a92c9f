"""Quality rules combined by weak supervision.

Each rule votes good, votes bad or abstains. How often each rule is right is not
known; expectation-maximisation estimates it from how the rules agree over all
documents, together with the share of good documents. A document is kept when
its posterior probability of being good is high enough, not when it passes
every rule.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import store
from riskloom.llm.bytes_np import hashes, shingle_hashes, word_bounds

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_letters long, n_capitals long, n_distinct_words long, n_ended_lines long"
)
NAMES = [part.split()[0] for part in MEASURES.split(", ")]
# (name, votes good when, votes bad when); a rule abstains otherwise. Most look for one
# fault only and say nothing about texts without it.
RULES = [
    ("length", None, "n_words < 20"),
    ("word_length", None, "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("symbols", None, "10 * n_symbols > n_words"),
    ("dup_lines", None, "2 * n_dup_lines > n_lines"),
    ("repeats", None, "10 * n_repeat_words > 3 * n_words"),
    ("letters", None, "20 * n_letters < 17 * word_chars"),
    ("capitals", None, "2 * n_capitals > n_letters"),
    ("variety", None, "10 * n_distinct_words < n_words"),
    ("line_ends", None, "10 * n_ended_lines < n_lines"),
    ("plain", "50 * n_symbols <= n_words and 20 * n_letters >= 17 * word_chars and 5 * n_capitals <= n_letters", None),
    ("flowing", "20 * n_repeat_words <= n_words and 4 * n_distinct_words >= n_words and 20 * n_symbols <= n_words "
     "and 3 * n_capitals <= n_letters", None),
]
ROUNDS = 200
KEEP_FROM = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0xC0:] = True  # the first byte of any character beyond ASCII
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True
_WHITE = "\t\n\x0b\x0c\r "


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text; all 0 for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    if not n:
        return (0, 0, int(_SYMBOL[data].sum()), *[0] * 7)
    words = hashes(data, starts, ends)
    lines = [x for x in (text or "").split("\n") if x.strip(_WHITE)]
    repeat = 0
    if n >= 3:
        _, group, count = np.unique(shingle_hashes(words, 3), return_inverse=True, return_counts=True)
        again = count[group] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeat = int(covered.sum())
    follows = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_FOLLOWS[data], out=follows[1:])
    chars = int((ends - starts).sum() - (follows[ends] - follows[starts]).sum())
    return (
        n, chars, int(_SYMBOL[data].sum()), sum(c - 1 for c in Counter(lines).values()), repeat,
        len(lines), int(_LETTER[data].sum()), int(_CAPITAL[data].sum()), len(np.unique(words)),
        sum(x.rstrip(_WHITE)[-1] in ".!?:;\"')" for x in lines),
    )


def with_measures(docs: DataFrame, text_col: str = "text", into: str = "measures") -> DataFrame:
    """All rows and columns with a struct of measures; no shuffle."""

    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=NAMES)

    return store.bounded_batches(docs).withColumn(into, measured(F.col(f"`{text_col}`").cast("string")))


def votes(rules=RULES) -> Column:
    """One letter per rule: g good, b bad, - abstains. No rule calls a text without words good."""
    return F.concat(*[
        F.expr(f"CASE WHEN {bad or 'false'} THEN 'b' WHEN ({good or 'false'}) AND n_words > 0 THEN 'g' ELSE '-' END")
        for _, good, bad in rules
    ])


@dataclass
class LabelModel:
    """Share of good documents, and for both classes how often each rule casts each vote."""

    good: float
    chances: np.ndarray  # class (bad, good) x rule x vote (b, -, g)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of good for each vote pattern."""
        seen = _coded(patterns)
        logs = np.log(self.chances)
        both = [np.log(p) + sum(logs[c, r, seen[:, r]] for r in range(seen.shape[1])) for c, p in enumerate((1 - self.good, self.good))]
        return 1 / (1 + np.exp(np.clip(both[0] - both[1], -700, 700)))


def _coded(patterns: list[str]) -> np.ndarray:
    return np.array([["b-g".index(v) for v in p] for p in patterns], int).reshape(len(patterns), -1)


# Chances of the votes b, -, g in bad and in good documents before anything is estimated,
# by whether a rule casts both votes, only bad or only good ones.
_START = {
    "bg": ([0.4, 0.5, 0.1], [0.1, 0.5, 0.4]),
    "b": ([0.3, 0.69, 0.01], [0.02, 0.97, 0.01]),
    "g": ([0.01, 0.69, 0.3], [0.01, 0.19, 0.8]),
}


def fit_patterns(patterns: list[str], counts: list[int], rounds: int = ROUNDS) -> LabelModel | None:
    """Expectation-maximisation over vote patterns and the number of documents with each.

    It starts from rules that are right more often than not, and from four good
    documents in five. None without documents.
    """
    if not patterns:
        return None
    order = np.argsort(np.array(patterns))
    patterns, n = [patterns[i] for i in order], np.array(counts, float)[order]
    seen = _coded(patterns)
    casts = ["".join(v for v in "bg" if any(p[r] == v for p in patterns)) or "bg" for r in range(seen.shape[1])]
    start = np.array([[_START[kind][c] for kind in casts] for c in (0, 1)])
    model = LabelModel(0.8, start)
    for _ in range(rounds):
        good = model.posterior(patterns)
        share = float(np.clip((n * good).sum() / n.sum(), 1e-6, 1 - 1e-6))
        chances = np.empty_like(start)
        for c, weight in enumerate((n * (1 - good), n * good)):
            for r in range(seen.shape[1]):
                # One vote's worth of the start keeps every chance above 0.
                chances[c, r] = np.bincount(seen[:, r], weights=weight, minlength=3) + start[c, r]
        model = LabelModel(share, chances / chances.sum(2, keepdims=True))
    return model


def fit(voted: DataFrame, pattern_col: str = "votes") -> LabelModel | None:
    """Estimate from the votes of all documents. At most 3 to the power of the rules patterns reach the driver."""
    rows = voted.groupBy(F.col(pattern_col).alias("p")).agg(F.count("*").alias("n")).collect()
    return fit_patterns([r.p for r in rows], [r.n for r in rows])


def with_posterior(voted: DataFrame, model: LabelModel | None, pattern_col: str = "votes", into: str = "posterior") -> DataFrame:
    """All rows with their posterior; 0.5 without a model. One broadcast of the known patterns."""
    if model is None:
        return voted.withColumn(into, F.lit(0.5))
    patterns = [r.p for r in voted.select(F.col(pattern_col).alias("p")).distinct().orderBy("p").collect()]
    pattern, posterior = store.new_names(voted, "pattern", "posterior")
    known = [(p, float(x)) for p, x in zip(patterns, model.posterior(patterns))]
    table = voted.sparkSession.createDataFrame(known, f"{pattern} string, {posterior} double")
    kept = [F.col(f"`{c}`") for c in voted.columns if c != into]
    return voted.join(F.broadcast(table), F.col(pattern_col) == F.col(pattern), "left").select(*kept, F.col(posterior).alias(into))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measures, votes, posterior, base_failed and kept of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated windows
    of three. Such rows are not kept; the others are when the posterior is at least
    KEEP_FROM. Null and empty texts have no words. Repeated rows are judged alike,
    each counts.
    """
    rows = with_measures(store.named(docs, id=id_col, text=text_col))
    voted = store.written(rows.select("id", "measures.*").withColumn("votes", votes()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        with_posterior(voted, fit(voted)).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))
    )
