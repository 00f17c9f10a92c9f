"""CSV with quoted line breaks, read in many tasks per file.

Spark hands out a file's lines in chunks (byte ranges that end at line ends). What a
chunk does to "inside a quoted field" is worked out for both ways it may begin; put
together over the chunks of a file this tells how each really begins. Lines are
then joined to records chunk by chunk; only a record that crosses chunks is put
together by a grouping.

A quote opens a field only where one begins, and doubled quotes stay inside, as in
Spark's own reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskloom.functions.shipping import ship

_RECORD, _HEAD, _TAIL = 0, 1, 2
_COMMA, _QUOTE = b",", b'"'


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, by whether one is at its beginning."""
    at = 0
    while True:
        if inside or line.startswith(_QUOTE, at):
            at += not inside
            inside = False
            while True:
                quote = line.find(_QUOTE, at)
                if quote < 0:
                    return True
                if not line.startswith(_QUOTE, quote + 1):
                    break
                at = quote + 2
            at = quote + 1
        comma = line.find(_COMMA, at)
        if comma < 0:
            return False
        at = comma + 1


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """The rows of a batch by chunk, in their order."""
    key = list(zip(batch["file"], batch["start"]))
    edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield key[a], batch.iloc[a:b]


def _chunk_ends(lines: DataFrame) -> DataFrame:
    """file, start, out_of, in_: whether a chunk ends inside a quoted field, when it begins outside or inside one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, states, done = None, (False, True), []
        for batch in batches:
            for key, rows in _runs(batch):
                if key != own:
                    if own is not None:
                        done.append((*own, *states))
                    own, states = key, (False, True)
                for line in rows["value"]:
                    if _QUOTE in line:
                        states = tuple(ends_inside(line, s) for s in states)
        if own is not None:
            done.append((*own, *states))
        yield pd.DataFrame(done, columns=["file", "start", "out_of", "in_"])

    return lines.mapInPandas(run, "file string, start long, out_of boolean, in_ boolean")


def _begin_inside(ends: DataFrame) -> DataFrame:
    """file, start, begins of the chunks that begin inside a quoted field. One row a chunk is ordered."""
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("file").orderBy("start")
    same, flips = F.col("out_of") == F.col("in_"), (F.col("out_of") & ~F.col("in_")).cast("int")
    counted = ends.withColumn("turns", F.sum(flips).over(so_far))
    last = F.last(F.when(same, F.struct("out_of", "turns")), ignorenulls=True).over(before)
    known = counted.withColumn("known", last).withColumn("earlier", F.coalesce(F.last("turns").over(before), F.lit(0)))
    turned = (F.col("earlier") - F.coalesce("known.turns", F.lit(0))) % 2 == 1
    begins = F.coalesce("known.out_of", F.lit(False)) != turned
    return known.select("file", "start", begins.alias("begins")).where("begins")


_PIECE = "kind int, file string, start long, first boolean, record binary"


def _pieces(lines: DataFrame, strip: bool) -> DataFrame:
    """Whole records, the end of one begun before a chunk, and the beginning of one that goes on behind it.

    `first` marks the first record of a file. Empty lines outside of fields are no records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, inside, held, head, first = None, False, [], False, False
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.append((_HEAD if head else _TAIL, *own, first and not head, b"\n".join(held)))

        for batch in batches:
            for key, rows in _runs(batch):
                if key != own:
                    close()
                    own, inside, held, first = key, bool(rows["begins"].iloc[0]), [], key[1] == 0
                    head = inside
                for line in rows["value"]:
                    if strip and line.endswith(b"\r"):
                        line = line[:-1]
                    if not inside and not line:
                        continue
                    held.append(line)
                    if inside or _QUOTE in line:
                        inside = ends_inside(line, inside)
                    if not inside:
                        out.append((_HEAD if head else _RECORD, *own, first and not head, held[0] if len(held) == 1 else b"\n".join(held)))
                        first, head, held = first and head, False, []
            yield pd.DataFrame(out, columns=["kind", "file", "start", "first", "record"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["kind", "file", "start", "first", "record"])

    return lines.mapInPandas(run, _PIECE)


def _records(pieces: DataFrame) -> DataFrame:
    """One row `record` for every record but the first of each file."""
    whole = pieces.where((F.col("kind") == _RECORD) & ~F.col("first")).select("record")
    order = W.partitionBy("file").orderBy("start", "kind")
    crossing = pieces.where(F.col("kind") != _RECORD).withColumn("number", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", F.col("record").cast("string").alias("record"))))
    joined = crossing.groupBy("file", "number").agg(F.max("first").alias("first"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n").cast("binary")
    return whole.unionByName(joined.where(~F.col("first")).select(text.alias("record")))


def read_split_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """The records of CSV files with a header, all columns as text, in no particular order.

    The header of the first file decides about line ends (with or without a carriage
    return). Encodings whose quotes, commas and line ends are those of ASCII can be read. The files
    are read twice; chunks that begin inside a field, at most one row for each, are broadcast.
    """
    ship(spark)
    raw = spark.read.option("lineSep", "\n").text(path)
    opening = raw.first()
    strip = opening is not None and opening["value"].endswith("\r")
    lines = raw.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    inside = F.broadcast(_begin_inside(_chunk_ends(lines)))
    marked = lines.join(inside, ["file", "start"], "left").select("value", "file", "start", F.coalesce("begins", F.lit(False)).alias("begins"))
    records = _records(_pieces(marked, strip))
    text = F.col("record").cast("string") if encoding.upper().replace("-", "") == "UTF8" else F.decode("record", encoding)
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in names)
    parsed = records.select(F.from_csv(text, schema, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}).alias("r"))
    return parsed.select(*[F.col(f"r.{n}").alias(c) for n, c in zip(names, columns)])
