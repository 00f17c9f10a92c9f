"""SentencePiece encoding and decoding by streaming Viterbi.

Every position of a text keeps the best path that ends there, but only as far back as
the longest piece reaches. Whenever all paths in that window come from one boundary,
the ids up to it are final and are given out; memory does not grow with the text.
Where no piece of the vocabulary can cover two neighbouring characters, all paths
meet between them, so what follows depends on nothing before it: its ids are
remembered in a cache of bounded size.

Paths are compared by the sum of the file's piece scores; of equal ones the one with
the longer last piece wins. For a file of merge ranks (model type BPE) this is the
best path under these scores, not the order of merges.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.llm import store
from riskloom.llm.memo import Memo

SPACE = "▁"
# Bytes of a generation of remembered words, and of remembered parts of words.
WORD_BYTES, RUN_BYTES = 20 << 20, 4 << 20
# Added to the lowest score for a character that no piece covers.
_UNKNOWN_PENALTY = 10.0
_NONE = float("-inf")
_NO_PIECE = object()
# In place of the id of a character that no piece covers.
_UNCOVERED = -1
_LEAF: dict[str, tuple] = {}


class Vocabulary:
    """Pieces and scores of a SentencePiece file, spaces as U+2581, unknown characters as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: float(model.get_score(i)) for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.unknown_id = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - _UNKNOWN_PENALTY
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Every beginning of a piece, with the score if it is a piece itself.
        self.beginnings = {p[:i]: self.scores.get(p[:i]) for p in self.ids for i in range(1, len(p) + 1)}
        self.tree = self._tree()
        # What a piece is in a text.
        self.written = np.array([p.replace(SPACE, " ") for p in self.pieces], dtype=object)

    def _tree(self) -> dict[str, tuple]:
        """The beginnings by their next character: (score, id, what may follow); one that is no piece never wins."""
        below: dict[str, dict] = {}
        # Longest first, so that what follows a beginning is there before it.
        for start in sorted(self.beginnings, key=len, reverse=True):
            score = self.beginnings[start]
            if score is None:
                score = self.unknown if len(start) == 1 else _NONE
            below.setdefault(start[:-1], {})[start[-1]] = score, self.ids.get(start, _UNCOVERED), below.get(start, _LEAF)
        return below.get("", {})

    def spell(self, char: str) -> list[int]:
        """The ids of a character that no piece covers."""
        if len(self.bytes) < 256:
            return [self.unknown_id]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """Feed characters, take ids: `feed` returns those that became final, `close` the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._start()

    def _start(self) -> None:
        self.window = ""  # characters behind the last committed boundary
        self.best = [0.0]  # of each boundary in the window, the first being the committed one
        self.back = [0]
        self.alive: list[int] = []  # boundaries from which a piece may still grow over the end

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        step = self.v.longest
        for at in range(0, len(chars), step):
            self._extend(chars[at : at + step])
            if len(self.window) >= 2 * step:
                out += self._commit(self._meeting())
        return out

    def close(self) -> list[int]:
        out = self._commit(len(self.window))
        self._start()
        return out

    def _extend(self, chars: str) -> None:
        window, best, back, alive = self.window, self.best, self.back, self.alive
        find, unknown, end = self.v.beginnings.get, self.v.unknown, len(window)
        for char in chars:
            window += char
            alive.append(end)
            end += 1
            top, origin, grown, score = _NONE, end - 1, [], _NONE
            for start in alive:
                score = find(window[start:end], _NO_PIECE)
                if score is _NO_PIECE:
                    continue
                grown.append(start)
                if score is not None and score + best[start] > top:
                    top, origin = score + best[start], start
            # The last look-up was for the character by itself.
            if (score is None or score is _NO_PIECE) and unknown + best[end - 1] > top:
                top, origin = unknown + best[end - 1], end - 1
            best.append(top)
            back.append(origin)
            alive = grown
        self.window, self.alive = window, alive

    def _meeting(self) -> int:
        """The last boundary through which every path that can still grow runs."""
        alive = {*self.alive, len(self.window)}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        return alive.pop()

    def _commit(self, boundary: int) -> list[int]:
        """The ids of the best path up to a boundary, which becomes the window's first."""
        spans, at = [], boundary
        while at > 0:
            spans.append((self.back[at], at))
            at = self.back[at]
        out: list[int] = []
        for start, end in reversed(spans):
            piece = self.window[start:end]
            found = self.v.ids.get(piece)
            out += self.v.spell(piece) if found is None else [found]
        base = self.best[boundary]
        self.window = self.window[boundary:]
        self.best = [x - base for x in self.best[boundary:]]
        self.back = [max(0, b - boundary) for b in self.back[boundary:]]
        self.alive = [a - boundary for a in self.alive]
        return out


def window_path(v: Vocabulary, chars: str) -> list[int]:
    """The ids of the best path through characters that fit into one window, as `StreamingViterbi` finds it.

    Nothing has to be given out early, so every boundary just hands its score on to the pieces
    that begin there; of equal paths the earlier beginning, the longer last piece, stays.
    """
    n, unknown = len(chars), v.unknown
    best, back, last = [0.0] + [_NONE] * n, [0] * (n + 1), [_UNCOVERED] * (n + 1)
    for start in range(n):
        base, end, below = best[start], start, v.tree
        for char in chars[start:]:
            node = below.get(char)
            if node is None:
                if end == start and base + unknown > best[start + 1]:
                    best[start + 1], back[start + 1], last[start + 1] = base + unknown, start, _UNCOVERED
                break
            end += 1
            score, piece, below = node
            score += base
            if score > best[end]:
                best[end], back[end], last[end] = score, start, piece
    out, at = [], n
    while at:
        if last[at] == _UNCOVERED:
            out += reversed(v.spell(chars[at - 1]))
        else:
            out.append(last[at])
        at = back[at]
    out.reverse()
    return out


class PieceCodec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, word_bytes: int = WORD_BYTES, run_bytes: int = RUN_BYTES):
        self.v = Vocabulary(path)
        self.runs, self.words = Memo(run_bytes), Memo(word_bytes)  # words: by what stands behind a space
        # Whether a space is only ever the beginning of a piece or follows another space.
        self.cut_at_space = all(a == SPACE for a, b in self.v.joins if b == SPACE)

    def _runs(self, chars: str) -> list[str]:
        """The parts of a text between which no piece reaches."""
        joins = self.v.joins
        cuts = [i for i, pair in enumerate(zip(chars, chars[1:]), 1) if pair[0] + pair[1] not in joins]
        return [chars[a:b] for a, b in zip([0, *cuts], [*cuts, len(chars)])] if cuts else [chars]

    def _fresh(self, chars: str) -> bytes:
        if len(chars) <= 2 * self.v.longest:
            return array("I", window_path(self.v, chars)).tobytes()
        runs, stream = self._runs(chars), StreamingViterbi(self.v)
        found, unknown = self.runs.find(runs)
        for i in unknown:
            found[i] = array("I", stream.feed(runs[i]) + stream.close()).tobytes()
            if len(runs[i]) <= 2 * self.v.longest:
                self.runs.put(runs[i], found[i])
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        """The ids of a word behind a space. A last character that no piece joins to the one
        before it, as most marks, is looked up apart."""
        if len(word) > 1 and word[-2:] not in self.v.joins:
            body = self.words.get(word[:-1])
            return (self._word(word[:-1]) if body is None else body) + self._end(word[-1])
        ids = self._fresh(SPACE + word)
        if len(word) < 2 * self.v.longest:
            self.words.put_again(word, ids)
        return ids

    def _end(self, char: str) -> bytes:
        ids = self.runs.get(char)
        if ids is None:
            ids = self._fresh(char)
            self.runs.put(char, ids)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for a null or an empty one.

        One space is put before the text, as the file's normaliser does.
        """
        if not text:
            return np.zeros(0, np.uint32)
        if not self.cut_at_space or "  " in text or text[0] == " " or text[-1] == " ":
            return np.frombuffer(self._fresh((" " + text).replace(" ", SPACE)), "<u4")
        # A space opens every word, and no piece reaches over it from the left.
        words = text.split(" ")
        found, unknown = self.words.find(words)
        for i in unknown:
            found[i] = self._word(words[i])
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces side by side, bytes joined, the first space taken off."""
        ids = np.asarray(ids)
        if not len(ids) or not self.v.is_byte[ids].any():
            return "".join(self.v.written[ids].tolist()).removeprefix(" ")
        parts, pending = [], bytearray()
        for i in ids.tolist():
            byte = self.v.byte_of.get(i)
            if byte is not None:
                pending.append(byte)
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            parts.append(self.v.pieces[i])
        parts.append(pending.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ").removeprefix(" ")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of this worker process, with what it remembers."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def with_ids(docs: DataFrame, model: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """All rows and columns with the ids of their whole text; no shuffle.

    `model` is a path every executor can read. Nulls and empty texts have no ids. A
    column already named like the result is replaced.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([codec(model).encode(t).view(np.int32) for t in texts], dtype=object)

    return store.bounded_batches(docs).withColumn(into, encode(F.col(f"`{text_col}`").cast("string")))


def with_text(encoded: DataFrame, model: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """All rows and columns with the text of their ids; a null stays null.

    The result equals the encoded text unless that held U+2581 (given back as a space).
    """

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if r is None else codec(model).decode(r) for r in rows], dtype=object)

    return store.bounded_batches(encoded).withColumn(into, decode(F.col(f"`{ids_col}`")))


def with_round_trip(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """All rows and columns with a struct `trip`: n_ids, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) and whole (the decoded ids equal the text; null counts as empty)."""

    @F.pandas_udf("n_ids long, ids_crc32 long, whole boolean")
    def trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                ids = codec(model).encode(text)
                out.append((len(ids), zlib.crc32(ids.tobytes()), codec(model).decode(ids) == (text or "")))
            yield pd.DataFrame(out, columns=["n_ids", "ids_crc32", "whole"])

    return store.bounded_batches(docs).withColumn("trip", trip(F.col(f"`{text_col}`").cast("string")))
