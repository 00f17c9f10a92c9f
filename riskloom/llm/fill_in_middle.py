"""Fill-in-the-middle transformation with a piece table.

A document is a list of descriptors over two buffers that never change: its text
and the sentinels. Cutting splits a descriptor, arranging permutes the list, and
the digest of the result is taken descriptor by descriptor. The way back treats
the output as the text of a table of its own: it is cut around the sentinels, which
are left out, and the inverse permutation puts the parts in their first order.

A text is cut between units (runs of letters A-Z, a-z; any other character by
itself), so no word of letters is torn. All draws come from a digest of the
document's id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import store

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINELS = (PREFIX + SUFFIX + MIDDLE).encode()
FIM_PERCENT = 90
SPM_PERCENT = 20
SEED = 1
# The order of parts (0 prefix, 1 middle, 2 suffix) in a form, each behind its sentinel.
# "suffix first" opens with the suffix's sentinel, although its prefix comes second.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_SENTINEL_OF = (0, 2, 1)  # part -> place among the sentinels
TEXT, MARKS = 0, 1


@dataclass(frozen=True)
class Piece:
    """Bytes `start` to `end` of a buffer."""

    buffer: int
    start: int
    end: int

    @property
    def size(self) -> int:
        return self.end - self.start


class PieceTable:
    """Descriptors over buffers that are shared and never copied."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: list[Piece]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes) -> "PieceTable":
        return cls((text, _SENTINELS), [Piece(TEXT, 0, len(text))])

    def cut(self, places: list[int]) -> "PieceTable":
        """Split descriptors so that one ends at each place (bytes from the start, ascending).

        A place where a descriptor ends already gives an empty one, so that n places
        always give n more descriptors.
        """
        pieces, at, rest = [], 0, list(places)
        for piece in self.pieces:
            while rest and rest[0] <= at + piece.size:
                middle = piece.start + rest.pop(0) - at
                pieces.append(Piece(piece.buffer, piece.start, middle))
                at += pieces[-1].size
                piece = Piece(piece.buffer, middle, piece.end)
            pieces.append(piece)
            at += piece.size
        return PieceTable(self.buffers, pieces)

    def arranged(self, order: tuple[int, ...]) -> "PieceTable":
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def marked(self, parts: tuple[int, ...]) -> "PieceTable":
        """With the sentinel of the given part before each descriptor."""
        pieces = []
        for part, piece in zip(parts, self.pieces):
            at = 3 * _SENTINEL_OF[part]
            pieces += [Piece(MARKS, at, at + 3), piece]
        return PieceTable(self.buffers, pieces)

    def stream(self) -> Iterator[memoryview]:
        for piece in self.pieces:
            yield memoryview(self.buffers[piece.buffer])[piece.start : piece.end]

    def bytes(self) -> bytes:
        return b"".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def unit_starts(data: np.ndarray) -> np.ndarray:
    """The byte at which each unit of a UTF-8 text begins."""
    letter = ((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z"))
    begins = (data & 0xC0) != 0x80  # no byte within a character
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transformed(text: str | None, draws: tuple[int, int, int, int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """(number of units, form, characters of prefix and of middle, table) of one whole text.

    The first two draws place the cuts, the third and fourth choose the form.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts = unit_starts(data)
    n, table = len(starts), PieceTable.of(raw)
    if not n or any(s in raw for s in (b"<P>", b"<S>", b"<M>")) or draws[2] % 100 >= fim_percent:
        return n, "plain", None, None, table
    form = "spm" if draws[3] % 100 < spm_percent else "psm"
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    places = [int(starts[k]) if k < n else len(raw) for k in (low, high)]
    order = ORDERS[form]
    table = table.cut(places).arranged(order).marked(_heads(form))
    return n, form, characters(data[: places[0]]), characters(data[places[0] : places[1]]), table


def _heads(form: str) -> tuple[int, ...]:
    return ORDERS[form]


def restored(output: str | None, form: str | None) -> PieceTable:
    """The table of the text before, from the output and its form alone.

    Each sentinel stands once in the output, because texts that hold one stay plain.
    """
    raw = (output or "").encode("utf-8", "surrogatepass")
    table = PieceTable.of(raw)
    if form not in ORDERS:
        return table
    order = ORDERS[form]
    at = [raw.index(_SENTINELS[3 * _SENTINEL_OF[part] :][:3]) for part in order]
    if at[0] != 0 or at != sorted(at):
        raise ValueError(f"no output of form {form}")
    pieces = table.cut([x for a in at for x in (a, a + 3)])  # before and behind each sentinel
    return pieces.arranged((2, 4, 6)).arranged(inverse(order))


def draws_of(id_column: Column, seed: int = SEED) -> Column:
    """Four numbers from a digest of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


FIM = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def with_fim(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim",
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED,
) -> DataFrame:
    """All rows and columns with a struct: n units, form, prefix_chars, middle_chars, output
    (the arranged text) and output_sha256; no shuffle.

    A null text counts as empty; empty texts and texts with a sentinel stay plain, with
    null lengths. Rows with equal ids get equal draws. A column already named like the result is
    replaced, others are kept whatever their names.
    """

    @F.pandas_udf(FIM)
    def transform(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, draws in batches:
            rows = []
            for text, draw in zip(texts, draws):
                n, form, prefix, middle, table = transformed(text, tuple(map(int, draw)), fim_percent, spm_percent)
                output = (text or "") if form == "plain" else table.bytes().decode("utf-8", "surrogatepass")
                rows.append((n, form, prefix, middle, output, table.sha256()))
            yield _frame(rows, FIM)

    rows = store.bounded_batches(docs)
    return rows.withColumn(into, transform(F.col(f"`{text_col}`").cast("string"), draws_of(F.col(f"`{id_col}`"), seed)))


def with_restored(docs: DataFrame, output: Column, form: Column, into: str = "restored") -> DataFrame:
    """All rows and columns with a struct: text (before the transformation) and its sha256."""

    @F.pandas_udf("text string, sha256 string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            tables = [restored(o, f) for o, f in zip(outputs, forms)]
            rows = [(t.bytes().decode("utf-8", "surrogatepass"), t.sha256()) for t in tables]
            yield _frame(rows, "text string, sha256 string")

    return store.bounded_batches(docs).withColumn(into, back(output, form))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})
