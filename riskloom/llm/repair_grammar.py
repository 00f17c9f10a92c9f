"""The repair grammar of conversations and its weighted interval parser.

Legal conversations are `(s?(ua)+)?` over role initials. Nonterminals are pairs of
positions in that pattern: [p, q] stands for rows whose repair leads from p to q. The
grammar is in Chomsky normal form: [p, r] -> [p, q] [q, r], and [p, q] -> one row,
kept, given another role or deleted. Insertions are closed in: a row's cell already
allows any inserted turns before and behind it.

A cell holds the least (cost, audit) of its span, audits compared as ASCII. Two
audits of equal cost never are one the beginning of the other (the longer one would
only have more insertions, and cost more), so the least of a whole is made of the least
of its parts. As every nonterminal can be split at every place, all split points
of a span give the same cell: the chart holds spans of 1, 2, 4, ... rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)  # faults of a row
INITIALS = "sua"  # any other initial is the code behind them

# Positions in the pattern: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ENDS = (NOTHING, AFTER_A)

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]

# Spans of at most this many rows are remembered.
_SHORT = 32


def code(role: str, fault: int) -> int:
    """One number below 16 for what the grammar sees of a row."""
    at = INITIALS.find(role[:1]) if role else -1
    return 4 * (at if at >= 0 else len(INITIALS)) + fault


def product(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans together, by all rules [p, r] -> [p, q] [q, r]."""
    out: Cells = {}
    for (p, q), (cost, audit) in left.items():
        for r in range(4):
            other = right.get((q, r))
            if other is None:
                continue
            found, total = out.get((p, r)), cost + other[0]
            if found is None or total < found[0] or (total == found[0] and audit + other[1] < found[1]):
                out[p, r] = (total, audit + other[1])
    return out


def _insertions() -> Cells:
    """The cells of no rows at all: the fewest inserted turns between two positions."""
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    one = {(p, q): (INSERT_COST, INSERT) for (p, initial), q in STEPS.items() if initial in "ua"}
    while True:
        more = dict(cells)
        for key, cell in product(cells, one).items():
            more[key] = min(cell, more.get(key, cell))
        if more == cells:
            return cells
        cells = more


NO_ROWS = _insertions()


@lru_cache(maxsize=16)
def row_cells(row: int) -> Cells:
    initial, fault = (INITIALS + "?")[row // 4], row % 4
    cells: Cells = {(p, p): (DELETE_COST, DELETE) for p in range(4)}
    if fault in (FINE, TRUNCATED):
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for (p, step), q in STEPS.items():
            ways = [(extra, KEEP)] if step == initial else []
            if step in "ua":
                ways.append((REROLE_COST + extra, REROLE))
            for way in ways:
                cells[p, q] = min(way, cells.get((p, q), way))
    return product(product(NO_ROWS, cells), NO_ROWS)


def combined(spans: list[Cells]) -> Cells:
    """Neighbouring spans joined bottom-up by their length."""
    while len(spans) > 1:
        spans = [product(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else NO_ROWS


@lru_cache(maxsize=20_000)
def _short_cells(rows: bytes) -> Cells:
    return combined([row_cells(r) for r in rows])


def span_cells(rows: bytes) -> Cells:
    """The cells of a span of row codes."""
    return combined([_short_cells(rows[i : i + _SHORT]) for i in range(0, len(rows), _SHORT)])


def best(cells: Cells) -> Cell:
    """The least repair of a whole conversation."""
    return min(cells[NOTHING, end] for end in ENDS if (NOTHING, end) in cells)


def expected(position: int) -> str:
    return "assistant" if position == AFTER_U else "user"


def walk(audit: str, roles: list[str], position: int = NOTHING) -> Iterator[tuple[str, str, int | None, int]]:
    """(edit, role, row, position behind it) for every edit; row is None for inserted turns."""
    row = 0
    for edit in audit:
        at = None
        if edit != INSERT:
            at, row = row, row + 1
        role = roles[at] if edit in (KEEP, DELETE) else expected(position)
        if edit != DELETE:
            position = STEPS[position, role[:1]]
        yield edit, role, at, position


def pieces(audit: str, lengths: list[int]) -> list[str]:
    """An audit cut behind the last row of each part; what follows the last row is the last part's."""
    out, begin, at = [], 0, 0
    for n in lengths[:-1]:
        while n:
            n -= audit[at] != INSERT
            at += 1
        out.append(audit[begin:at])
        begin = at
    return [*out, audit[begin:]]
