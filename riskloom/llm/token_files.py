"""Token ids in files of directly addressable codes.

An id is split into chunks of a few bits, lowest first. Level k holds the k-th chunk of
every id that has one, side by side, and a bitmap that tells which of them go on to
level k + 1. A rank directory counts the set bits before every block of the bitmap,
so the place of an id's next chunk is one look-up and one count within a block: any
token is read by itself, nothing before it is decoded.

A file part holds whole documents in ascending id order; its rows (segments) are
binary columns of Parquet, so any store Spark writes to will do.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskloom.llm import store
from riskloom.llm.memo import Memo

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
# Bytes of a generation of remembered pieces.
PIECE_BYTES = 96 << 20
LONGEST_CACHED = 64
# A letter of Western alphabets with marks behind it. The file never joins them.
_MARKS_IN_A_ROW = re.compile(r"[^a-zß-öø-ÿ0-9\s][.,](?=[ \n])")
_MARKS_BEHIND = re.compile(r"(?<=[a-zß-öø-ÿ])([.,!?;:*%$#&|]+)")
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SEGMENT = "part int, segment int, n_docs int, n_tokens long, ids binary, ends binary, levels array<struct<chunks: binary, more: binary, ranks: binary>>"


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of a sequence of ids below 2^32, lowest chunks first."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(CHUNK_BITS)
        goes_on = rest > 0
        more = np.packbits(goes_on, bitorder="little")
        blocks = np.zeros(-(-max(1, len(more)) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        blocks[: len(more)] = _POPCOUNT[more]
        counts = blocks.reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        levels.append({"chunks": chunks.tobytes(), "more": more.tobytes(), "ranks": ranks.tobytes()})
        if not goes_on.any():
            return levels
        rest = rest[goes_on]


@dataclass
class Levels:
    """Random access to the ids of one segment."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, stored) -> "Levels":
        return cls([
            (np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in stored
        ])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order; only their own chunks are read."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        alive = np.arange(len(at))
        for k, (chunks, more, ranks) in enumerate(self.levels):
            out[alive] |= chunks[at].astype(np.uint32) << np.uint32(k * CHUNK_BITS)
            on = (more[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive, at = alive[on], at[on]
            if not len(at):
                break
            at = self._rank(more, ranks, at)
        return out

    @staticmethod
    def _rank(more: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place: the directory, then the block's bytes, then the byte's bits."""
        block, byte = at // RANK_BITS, at >> 3
        first = block * (RANK_BITS // 8)
        if len(at) * 8 > len(more):  # many places: the bytes' counts once for all
            sums = np.concatenate([[0], np.cumsum(_POPCOUNT[more], dtype=np.int64)])
            inner = sums[byte] - sums[first]
        else:
            inner = np.array([int(_POPCOUNT[more[a:b]].sum()) for a, b in zip(first, byte)], np.int64)
        low = more[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return ranks[block].astype(np.int64) + inner + _POPCOUNT[low]


# How a file must normalise and part texts for the cuts below to be its own.
KNOWN_CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


class WordEncoder:
    """Ids of whole texts by a tokenizers file.

    Any file gives the library's ids. For a file with KNOWN_CUTS, whose words never cross
    white space, most texts are put together from pieces:

    Texts are cut at spaces, line ends and between a letter and the marks behind it,
    where the file cuts them too; the ids of a piece are remembered. Texts for which
    this may differ from the library (other than composed form, letters whose lower
    case depends on their place, special tokens) go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(PIECE_BYTES)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.openings = {s[:2].lower() for s in specials}
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.known = all(stored.get(part) == value for part, value in KNOWN_CUTS.items())

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _pieces(self, text: str) -> list[str] | None:
        """What can be encoded piece by piece; None for a text the library must see whole."""
        if not self.known:
            return None
        low = text.lower()
        if "Σ" in text or "İ" in text or any(s in low for s in self.openings) or not unicodedata.is_normalized("NFC", low):
            return None
        if _MARKS_IN_A_ROW.search(low):
            low = _MARKS_BEHIND.sub(r" \1", low)
        else:
            low = low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
        return low.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null."""
        parts = []
        for text in texts:
            pieces = self._pieces(text or "")
            parts.append((text, None, None, []) if pieces is None else (text, pieces, *self.memo.find(pieces)))
        # The new pieces of all these texts at once.
        new = sorted({pieces[i] for _, pieces, _, unknown in parts for i in unknown})
        learnt = dict(zip(new, self._library(new)))
        for piece, ids in learnt.items():
            if len(piece) <= LONGEST_CACHED:
                self.memo.put(piece, ids)
        out = []
        for text, pieces, found, unknown in parts:
            if pieces is None:
                found = self._library([text])
            for i in unknown:
                found[i] = learnt[pieces[i]]
            out.append(np.frombuffer(b"".join(found), "<u4"))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS, partitions: int | None = None,
) -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending order of the documents' ids.

    Rows with equal ids are ordered by their texts; a null id comes first. A null
    text is empty. `tokenizer` is a path that every executor can read. A segment ends
    with the document that brings it to `segment_tokens`; a task holds one segment.
    """
    rows = (
        store.named(docs, id=id_col, text=text_col)
        .select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
    )
    spread = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(spread, "id", "tie").sortWithinPartitions("id", "tie", "text")
    end = np.array([] if end_id is None else [end_id], "<u4")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0

        def segment() -> pd.DataFrame:
            counts = np.cumsum([len(t) for t in tokens], dtype=np.int64)
            flat = np.concatenate(tokens)
            return pd.DataFrame({
                "part": [part], "segment": [number], "n_docs": [len(ids)], "n_tokens": [len(flat)],
                "ids": [np.array(ids, "<i8").tobytes()], "ends": [counts.astype("<i8").tobytes()], "levels": [encode_levels(flat)],
            })

        for piece in store.pieces(batches):
            for i, encoded in zip(piece["key"], encoder(tokenizer).encode(piece["text"].tolist())):
                ids.append(i)
                tokens.append(np.concatenate([encoded, end]))
                size += len(tokens[-1])
                if size >= segment_tokens:
                    yield segment()
                    ids, tokens, size, number = [], [], 0, number + 1
        if ids:
            yield segment()

    # A null id is stored as the smallest long; ids themselves are written as they are.
    keyed = ordered.select(F.coalesce("id", F.lit(_NULL_ID)).alias("key"), "text")
    keyed.mapInPandas(segments, SEGMENT).write.option("compression", "uncompressed").parquet(folder)


_NULL_ID = -(2**63)


def read_tokens(spark: SparkSession, folder: str, columns: str, summarise: Callable[[np.ndarray], tuple]) -> DataFrame:
    """id, start, n_tokens and `columns` for every document of the files, decoded by direct access.

    `start` counts the ids of all documents before it; `summarise` makes the further
    columns from a document's ids.
    """
    stored = store.bounded_batches(spark.read.schema(SEGMENT).parquet(folder))
    sizes = store.written(stored.select("part", "segment", "n_tokens"))
    # Segments are few: one row for about a million tokens, summed by part first.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("segment")
    starts = sizes.withColumn("inside", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(F.broadcast(before), "part")
    placed = starts.select("part", "segment", (F.col("before") + F.col("inside")).alias("first"))
    names = [c.split()[0] for c in columns.split(", ")]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, ends = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.ends, "<i8")
                levels, begins = Levels.of(row.levels), np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ids), 512):
                    low, high = int(begins[at]), int(ends[min(at + 512, len(ids)) - 1])
                    flat = levels.get(np.arange(low, high))
                    made = [summarise(flat[b - low : e - low]) for b, e in zip(begins[at : at + 512], ends[at : at + 512])]
                    yield pd.DataFrame({
                        "id": ids[at : at + 512], "start": row.first + begins[at : at + 512], "n_tokens": ends[at : at + 512] - begins[at : at + 512],
                        **{name: [m[k] for m in made] for k, name in enumerate(names)},
                    })

    keyed = stored.join(store.few(store.written(placed)), ["part", "segment"])
    rows = keyed.select("ids", "ends", "levels", "first").mapInPandas(documents, f"id long, start long, n_tokens long, {columns}")
    return rows.withColumn("id", F.when(F.col("id") != _NULL_ID, F.col("id")))


def token_at(spark: SparkSession, folder: str, part: int, segment: int, place: int) -> int:
    """One token of the files by its place in a segment; only that row is read."""
    row = spark.read.schema(SEGMENT).parquet(folder).where((F.col("part") == part) & (F.col("segment") == segment)).select("levels").first()
    return int(Levels.of(row.levels).get(np.array([place]))[0])


def crc_of(ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
