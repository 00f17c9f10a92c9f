"""Repair of conversations at the least cost.

Rows are put in order by range partitions of (conversation, turn, role, text), so
that a long conversation spreads over many tasks. A task that holds all rows of a
conversation repairs it at once. The others - conversations at the ends of a
partition, and those longer than a chunk - leave chunks of bounded size: chunks are
parsed apart, their cells are joined in order, and each chunk gets back its part of the
audit. Only the digest of a repaired conversation needs its text in order: chunks stream
through one task, which keeps nothing but the running digest.

Nulls in role or text count as one space. A null conversation is a conversation.
Turns are ordered, nulls first; equal turns by role and a digest of the text. Repeated rows stay
repeated (all but the first are duplicates). An empty table gives no rows. Columns
other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import repair_grammar as grammar, store

CHUNK_ROWS = 1024
CHUNK_CHARS = 1 << 20
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {"su", "ua", "au"}
_REPORT = "key string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_TURN = "array<struct<edit: string, role: string, text: string>>"
_CHUNK = "seq long, codes binary, digests binary, roles array<string>, texts array<string>, first_turn long, last_turn long, n_turns long"


def _key(conv: Column) -> Column:
    """The conversation as text; a null is the empty text."""
    return F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string")))


def _value(key: Column, kind: str) -> Column:
    return F.when(key != "", F.substring(key, 2, 2**31 - 1)).cast(kind)


class _Chunk:
    """Some neighbouring rows of one conversation, in order."""

    def __init__(self, key: str):
        self.key, self.chars = key, 0
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.codes, self.seen = bytearray(), {}
        self.first = self.last = None
        self.n_turns = 0

    def add(self, role: str, text: str, end: str, turn: int | None) -> None:
        fault = grammar.BLANK if not end else grammar.DUPLICATE if (role, text) in self.seen else grammar.FINE if end in ".!?" else grammar.TRUNCATED
        self.seen.setdefault((role, text), len(self.codes))
        self.codes.append(grammar.code(role, fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        if turn is not None:
            self.n_turns += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn

    def digests(self) -> bytes:
        """16 bytes for each different (role, text), then the row where each stands first."""
        sums = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in self.seen]
        return b"".join(sums) + np.array(list(self.seen.values()), "<u4").tobytes()


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:]))


def _faults(codes: bytes) -> tuple[int, int, int]:
    found = np.bincount(np.frombuffer(codes, np.uint8) % 4, minlength=4)
    return int(found[grammar.BLANK]), int(found[grammar.DUPLICATE]), int(found[grammar.TRUNCATED])


def _turns(audit: str, roles: list[str], texts: list[str], position: int = grammar.NOTHING) -> list[tuple[str, str, str]]:
    """(edit, role, text) of every row and inserted turn; deleted rows included."""
    return [(edit, role, "" if at is None else texts[at]) for edit, role, at, _ in grammar.walk(audit, roles, position)]


def _lines(turns: list[tuple[str, str, str]]) -> list[str]:
    return [f"{role}:{text}" for edit, role, text in turns if edit != grammar.DELETE]


def _structs(turns: list[tuple[str, str, str]]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in turns]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.replace(_TURN, "").split(", ")]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _first_pass(ordered: DataFrame, chunk_rows: int, chunk_chars: int, keep: bool) -> DataFrame:
    """Reports of conversations that a task holds whole, and chunks of all others."""
    schema = f"{_REPORT}, {_CHUNK}, turns {_TURN}"

    def whole(chunk: _Chunk, number: int) -> dict:
        codes = bytes(chunk.codes)
        cost, audit = grammar.best(grammar.span_cells(codes))
        turns = _turns(audit, chunk.roles, chunk.texts)
        blank, duplicate, truncated = _faults(codes)
        gaps = 0 if chunk.first is None else chunk.last - chunk.first + 1 - chunk.n_turns
        return {
            "key": chunk.key, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(chunk.roles),
            "cost": cost, "audit": audit, "repaired_sha256": _sha("\n".join(_lines(turns))), "seq": number, "turns": _structs(turns) if keep else None,
        }

    def part(chunk: _Chunk, number: int) -> dict:
        return {
            "key": chunk.key, "seq": number, "codes": bytes(chunk.codes), "digests": chunk.digests(), "roles": chunk.roles, "texts": chunk.texts,
            "first_turn": chunk.first, "last_turn": chunk.last, "n_turns": chunk.n_turns,
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, number, chunk, cut = TaskContext.get().partitionId() << 33, 0, None, True
        out: list[dict] = []
        for batch in store.pieces(batches):
            for key, turn, known, role, text, end in zip(*(batch[c].tolist() for c in ("key", "turn", "known", "role", "text", "end"))):
                same = chunk is not None and chunk.key == key
                if chunk is None or not same or len(chunk.codes) >= chunk_rows or chunk.chars >= chunk_chars:
                    if chunk is not None:
                        out.append((part if same or cut else whole)(chunk, base + number))
                        # A conversation that goes on, or opens the partition, may have rows elsewhere.
                        number, cut = number + 1, same
                    chunk = _Chunk(key)
                chunk.add(role, text, end, turn if known else None)
            yield _frame(out, schema)
            out = []
        if chunk is not None:
            yield _frame([part(chunk, base + number)], schema)

    return ordered.mapInPandas(run, schema)


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    named = store.named(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    plain = named.select(
        _key(F.col("conv")).alias("key"), F.coalesce(turn, F.lit(0)).alias("turn"), turn.isNotNull().alias("known"), role.alias("role"), text.alias("text"),
        # Spreads rows that are equal in everything else.
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["key", "known", "turn", "role", "tie", "row"]
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = plain.withColumn("tie", F.md5("text")).repartitionByRange(spread, *order).sortWithinPartitions(*order)
    return placed.select("key", "known", "turn", "role", "text", F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1).alias("end"))


def _repeats_elsewhere(chunks: DataFrame) -> DataFrame:
    """key, seq, repeats: the rows of a chunk whose role and text an earlier chunk of the conversation has."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, seq, packed in zip(batch["key"], batch["seq"], batch["digests"]):
                n = len(packed) // 20
                at = np.frombuffer(packed[16 * n :], "<u4")
                yield pd.DataFrame({"key": key, "seq": seq, "digest": [packed[16 * i : 16 * i + 16] for i in range(n)], "at": at.astype(np.int32)})

    long = chunks.groupBy("key").count().where("count > 1").select("key")
    rows = chunks.select("key", "seq", "digests").join(long, "key", "left_semi").mapInPandas(explode, "key string, seq long, digest binary, at int")
    rows = store.written(rows)
    first = rows.groupBy("key", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "digest", "first")
    # At most as many as a chunk has rows.
    return rows.join(first, ["key", "digest"]).where("seq > first").groupBy("key", "seq").agg(F.collect_list("at").alias("repeats"))


_PARSED = (
    "key string, seq long, codes binary, cells array<struct<p: int, q: int, cost: long, audit: string>>, blank long, duplicate long, truncated long, "
    "illegal long, opens string, closes string, first_turn long, last_turn long, n_turns long"
)


def _parse_chunks(chunks: DataFrame) -> DataFrame:
    """The cells and counts of every chunk by itself."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _PARSED.replace("struct<p: int, q: int, cost: long, audit: string>", "").split(", ")
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                codes = bytearray(row["codes"])
                for at in [] if row["repeats"] is None else row["repeats"]:
                    if codes[at] % 4 != grammar.BLANK:
                        codes[at] += grammar.DUPLICATE - codes[at] % 4
                cells = grammar.span_cells(bytes(codes))
                blank, duplicate, truncated = _faults(bytes(codes))
                roles = list(row["roles"])
                rows.append({
                    **{c: row[c] for c in ("key", "seq", "n_turns")}, "codes": bytes(codes),
                    **{c: None if row[c] is None else int(row[c]) for c in ("first_turn", "last_turn")},
                    "cells": [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cells.items()],
                    "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(roles),
                    "opens": roles[0][:1], "closes": roles[-1][:1],
                })
            columns = [n.split()[0] for n in names]
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})

    # Turns as text, so that a missing one stays apart from a number.
    turns = {c: F.col(c).cast("string") for c in ("first_turn", "last_turn")}
    return chunks.withColumns(turns).mapInPandas(parse, _PARSED)


_JOINED = f"{', '.join(f'{c} long' for c in COUNTS)}, audit string, parts array<struct<seq: long, edits: string, position: int>>"


def _join_chunks(parsed: DataFrame) -> DataFrame:
    """key, the report's counts, audit, parts: the chunks of a conversation joined in order.

    One row of cells a chunk meets in one task: some bytes for each row of the
    conversation, as its audit has, and no texts.
    """

    @F.pandas_udf(_JOINED)
    def join(conversations: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in conversations:
            yield pd.DataFrame([_joined(list(parts)) for parts in batch])

    fields = [c for c in parsed.columns if c != "key"]
    parts = parsed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    return parts.select("key", join("parts").alias("r")).select("key", "r.*")


def _joined(parts: list[dict]) -> dict:
    cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in part["cells"]} for part in parts]
    cost, audit = grammar.best(grammar.combined(cells))
    edits, position, cut = grammar.pieces(audit, [len(p["codes"]) for p in parts]), grammar.NOTHING, []
    for part, own in zip(parts, edits):
        cut.append({"seq": part["seq"], "edits": own, "position": position})
        initials = [(grammar.INITIALS + "?")[c // 4] for c in part["codes"]]
        for *_, position in grammar.walk(own, initials, position):
            pass
    dated = [p for p in parts if p["first_turn"] is not None]
    n_turns = sum(p["n_turns"] for p in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
    return {
        "gaps": dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - n_turns if dated else 0,
        **{c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")},
        "illegal": sum(p["illegal"] for p in parts) + sum(a["closes"] + b["opens"] not in _LEGAL for a, b in zip(parts, parts[1:])),
        "cost": cost, "audit": audit, "parts": cut,
    }


def _repair_chunks(chunks: DataFrame, joined: DataFrame) -> DataFrame:
    """key, seq, turns: every chunk repaired by its own part of the audit."""
    parts = joined.select("key", F.explode("parts").alias("p")).select("key", "p.*")

    @F.pandas_udf(_TURN)
    def repaired(edits: pd.Series, position: pd.Series, roles: pd.Series, texts: pd.Series) -> pd.Series:
        rows = zip(edits, roles, texts, position)
        return pd.Series([_structs(_turns(e, list(r), list(t), int(p))) for e, r, t, p in rows], dtype=object)

    rows = chunks.select("key", "seq", "roles", "texts").join(parts, ["key", "seq"])
    return rows.select("key", "seq", repaired("edits", "position", "roles", "texts").alias("turns"))


def _digests(repaired: DataFrame) -> DataFrame:
    """key, repaired_sha256: the digest of all chunks of a conversation in order, chunk by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, empty = None, None, True
        for batch in batches:
            done = []
            for own, turns in zip(batch["key"], batch["turns"]):
                if own != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest, empty = own, hashlib.sha256(), True
                for line in _lines([(t["edit"], t["role"], t["text"]) for t in turns]):
                    digest.update((line if empty else "\n" + line).encode("utf-8", "surrogatepass"))
                    empty = False
            yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "repaired_sha256"])

    return repaired.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, repaired_sha256 string")


def _run(rows: DataFrame, columns: tuple[str, str, str, str], chunk_rows: int, chunk_chars: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Reports by key, and (with `keep`) the repaired turns by key and seq."""
    passed = store.written(_first_pass(_ordered(rows, *columns), chunk_rows, chunk_chars, keep))
    whole, chunks = passed.where("codes is null"), passed.where("codes is not null")
    parsed = _parse_chunks(chunks.join(_repeats_elsewhere(chunks), ["key", "seq"], "left"))
    joined = store.written(_join_chunks(store.written(parsed)))
    mended = store.written(_repair_chunks(chunks, joined))
    report = ["key", *COUNTS, "audit", "repaired_sha256"]
    reports = whole.select(report).unionByName(joined.drop("parts").join(_digests(mended), "key").select(report))
    return reports, whole.select("key", "seq", "turns").unionByName(mended)


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Each row's first fault counts: blank, duplicate (role and text stand earlier), truncated
    (the last character that is no white space is none of `.!?`). `gaps` are missing numbers
    between the first and the last turn, `illegal` neighbours whose role initials are not su,
    ua or au. `audit` has the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert), the least in
    ASCII order among equally cheap ones; the digest is that of the repaired `role:text` lines.
    """
    reports, _ = _run(rows, (conv_col, turn_col, role_col, text_col), chunk_rows, chunk_chars, keep=False)
    kind = rows.schema[conv_col].dataType.simpleString()
    return reports.select(_value(F.col("key"), kind).alias(conv_col), *COUNTS, "audit", "repaired_sha256")


def repaired_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """The repaired conversations: their id, chunk, at, edit, role, text, in the order of (chunk, at).

    Inserted turns have an empty text; deleted rows are left out.
    """
    _, turns = _run(rows, (conv_col, turn_col, role_col, text_col), chunk_rows, chunk_chars, keep=True)
    kind = rows.schema[conv_col].dataType.simpleString()
    kept = F.filter("turns", lambda t: t["edit"] != grammar.DELETE)
    each = turns.select("key", F.col("seq").alias("chunk"), F.posexplode(kept).alias("at", "t"))
    return each.select(_value(F.col("key"), kind).alias(conv_col), "chunk", "at", "t.edit", "t.role", "t.text")
