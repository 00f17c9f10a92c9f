"""Removal of repeated passages of at least RUN_WORDS words, wherever they stand.

A text is one sequence of words (case, white space, line ends and marks between words
do not count). Every window of RUN_WORDS consecutive words that stands earlier in rank
(in a smaller id, or further ahead in the same text) is cut, overlapping and adjoining
windows as one passage, with its place in the original text retained.

The smallest digest of a few words inside a window, its gram, is the same in equal windows,
and neighbours mostly share theirs. Each stretch of windows with one gram is a row, compared
as a whole. Only where documents have different stretches around a gram, at the ends of
passages, the windows of the first document with each stretch are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.llm import store
from riskloom.llm.bytes_np import hashes, span_hashes

GRAM_WORDS = 8
RUN_WORDS = 30
_LOWER = bytes(range(256)).lower()
_WORD = np.zeros(256, bool)
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True
_WORD[128:] = True


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


class Windows:
    """The windows of `run_words` words of one whole text, in order; none in a shorter text."""

    def __init__(self, text: str | None, run_words: int = RUN_WORDS):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.data, self.run_words = np.frombuffer(raw.translate(_LOWER), np.uint8), run_words
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = _WORD[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.words = hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return max(0, len(self.words) - self.run_words + 1)

    def spans(self, first: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        return span_hashes(self.words, first, first + words).view(np.int64)

    @cached_property
    def digest(self) -> np.ndarray:
        return self.spans(np.arange(len(self)), self.run_words)

    @cached_property
    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, gram and digest of each stretch of windows with one gram."""
        width = min(GRAM_WORDS, self.run_words)
        grams = self.spans(np.arange(max(0, len(self) + self.run_words - width)), width) if len(self) else np.zeros(0, np.int64)
        least = smallest(grams, self.run_words - width + 1) if len(self) else grams
        first = np.flatnonzero(np.diff(least, prepend=least[:1] ^ 1) != 0)
        last = np.append(first[1:], len(self))[: len(first)] - 1
        return first, last, least[first], self.spans(first, last - first + self.run_words)

    def again(self) -> np.ndarray:
        """Whether the same window stands further ahead in this text, without a word in common."""
        _, first, which = np.unique(self.digest, return_index=True, return_inverse=True)
        return np.arange(len(self)) - first[which] >= self.run_words

    def chars(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of the first and end of the last windows, in characters."""
        before = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=before[1:])
        return before[self.starts[first]], before[self.ends[last + self.run_words - 1]]


_LAST = 2**63 - 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return store.named(docs, id=id_col, text=text_col).select(
        F.coalesce(F.col("id").cast("long"), F.lit(_LAST)).alias("id"), F.col("text").cast("string").alias("text")
    )


def _frame(columns: dict[str, str], parts: list[tuple]) -> pd.DataFrame:
    """Parts of equally long arrays (or single values for all) below one another."""
    kinds = {"long": np.int64, "int": np.int32, "boolean": bool}
    out = {}
    for k, (name, kind) in enumerate(columns.items()):
        out[name] = np.concatenate([np.zeros(0, kinds[kind]), *(np.broadcast_to(p[k], len(p[-1])).astype(kinds[kind]) for p in parts)])
    return pd.DataFrame(out)


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


_STRETCHES = {"id": "long", "gram": "long", "stretch": "long"}
_FOUND = {"id": "long", "row": "long", "again": "boolean", "first": "long", "pos": "int", "last": "int", "start": "int", "end": "int", "digest": "long"}


def shared_stretches(docs: DataFrame, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """id, stretches: of each document the stretches that a smaller id has too (`first`), and
    those that no smaller id has but that may have windows in common with others (`first`
    is the id itself). Written to the shared folder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in store.pieces(batches):
            parts = []
            for i, text in zip(batch["id"], batch["text"]):
                _, _, gram, stretch = Windows(text, run_words).stretches
                once = np.unique(stretch, return_index=True)[1]
                parts.append((i, gram[once], stretch[once]))
            yield _frame(_STRETCHES, parts)

    rows = store.written(_rows(docs, id_col, text_col).mapInPandas(cut, _schema(_STRETCHES)))
    shared = (
        rows.groupBy("gram").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("id", "stretch")])
        .where("min_id < max_id").select("gram", F.expr("min_stretch < max_stretch").alias("mixed"))
    )
    held = store.written(rows.join(store.few(store.written(shared)), "gram").select("id", "stretch", "mixed"))
    first = store.written(held.groupBy("stretch").agg(F.min("id").alias("first")))
    marked = held.join(store.few(first), "stretch").where("id > first or mixed")
    return store.written(marked.groupBy("id").agg(F.collect_set(F.struct("stretch", "first")).alias("stretches")))


def candidates(docs: DataFrame, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """Stretches that stand in the smaller id `first`, and single windows that others may have
    or that stand further ahead in the same text (`again`), with their place in words and
    characters and the digest of their first window. Written to the shared folder."""
    known = shared_stretches(docs, id_col, text_col, run_words)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in store.pieces(batches):
            parts = []
            for i, row, text, stretches, firsts in zip(batch["id"], batch["row"], batch["text"], batch["stretch"], batch["first"]):
                windows = Windows(text, run_words)
                single = again = windows.again()
                whole = np.zeros(0, np.int64)
                first, last, _, stretch = windows.stretches
                if stretches is not None and len(stretch):
                    order = np.argsort(stretches)
                    at = order[np.minimum(np.searchsorted(stretches, stretch, sorter=order), len(order) - 1)]
                    kept = np.where(stretches[at] == stretch, firsts[at], _NONE)
                    whole = np.flatnonzero((kept != _NONE) & (kept < i))
                    each = np.repeat(kept, last - first + 1)
                    single = (each == i) | again & ~((each != _NONE) & (each < i))
                    parts.append(_found(windows, i, row, again, kept[whole], first[whole], last[whole]))
                at = np.flatnonzero(single)
                parts.append(_found(windows, i, row, again, np.full(len(at), i), at, at))
            yield _frame(_FOUND, [p for p in parts if len(p[-1])])

    marks = known.select("id", "stretches.stretch", "stretches.first")
    # Rows may share an id; this number holds for the one table written here.
    numbered = _rows(docs, id_col, text_col).join(marks, "id", "left").select("id", F.monotonically_increasing_id().alias("row"), "text", "stretch", "first")
    return store.written(numbered.mapInPandas(cut, _schema(_FOUND)))


_NONE = -(2**63)


def _found(windows: Windows, i: int, row: int, again: np.ndarray, kept: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
    return i, row, again[first], kept, first, last, *(windows.chars(first, last) if len(first) else (first, last)), windows.digest[first]


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS,
) -> DataFrame:
    """id, start, end, n_words, kept: the passages to cut, in characters of the original text.

    `kept` is the smallest id that has the passage's first `run_words` words; it is the id
    itself where the text repeats itself. Null and empty texts and empty tables give no rows.
    A null id ranks behind all others and comes back as null. Rows that share an id
    count as one document: what they have in common is not cut from either.
    """
    found = candidates(docs, id_col, text_col, run_words)
    earliest = (
        found.where("first = id").groupBy("digest").agg(F.min("id").alias("earliest"), F.max("id").alias("latest"))
        .where("earliest < latest").select("digest", "earliest")
    )
    # A whole stretch may begin with a window that a still smaller id has in another stretch.
    early = store.written(earliest)
    later = found.join(store.few(early), "digest", "left").withColumn("kept", F.least("first", "earliest")).where("kept < id or again")
    each = later.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("pos", "last", "start", "end", "kept"))).alias("cut"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, pos, last, start, end, kept in zip(*(batch[c] for c in ("id", "pos", "last", "start", "end", "kept"))):
                edges = np.flatnonzero(pos[1:] - last[:-1] > run_words) + 1
                for a, b in zip([0, *edges], [*(edges - 1), len(pos) - 1]):
                    out.append((i, start[a], end[b], last[b] + run_words - pos[a], kept[a]))
            yield pd.DataFrame(out, columns=["id", "start", "end", "n_words", "kept"])

    cuts = each.select("id", *(f"cut.{c}" for c in ("pos", "last", "start", "end", "kept")))
    passages = cuts.mapInPandas(spans, "id long, start long, end long, n_words long, kept long")
    return passages.withColumns({c: F.when(F.col(c) != _LAST, F.col(c)) for c in ("id", "kept")})


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """All rows and columns, the text without its repeated passages; nulls stay null, rows stay.

    Rows with a null id are left as they are.
    """
    own, spans = store.new_names(docs, "id", "cuts")
    cuts = (
        repeated_passages(docs, id_col, text_col, run_words).where("id is not null")
        .groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans)).withColumnRenamed("id", own)
    )

    @F.pandas_udf("string")
    def keep(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cuts):
            if text is not None and spans is not None:
                at, parts = 0, []
                for span in spans:
                    parts.append(text[at : span["start"]])
                    at = max(at, span["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = docs.join(store.written(cuts), F.col(f"`{id_col}`") == F.col(own), "left")
    text = F.when(F.col(spans).isNull(), F.col(f"`{text_col}`").cast("string")).otherwise(keep(F.col(f"`{text_col}`").cast("string"), spans))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
