"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.fixed import WHITESPACE


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.trim(c, F.lit(WHITESPACE))


def number_or_null(c: Column) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes null."""
    return real_or_null(number_text(c).try_cast("double"))


def number_text(c: Column) -> Column:
    """Text of a number; null where only Java would read one ("1d", "1f")."""
    text = c.cast("string")
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text)


def real_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def with_numbers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add {new: old} columns read as numbers, each computed once.

    Text is parsed in one projection and tested for NaN in the next, so later
    uses of the column do not parse it again; numeric columns are only cast.
    """
    staged = {}
    for new, old in columns.items():
        text = isinstance(df.schema[old].dataType, T.StringType)
        staged[new] = (number_text(F.col(old)) if text else F.col(old)).try_cast("double")
    return df.withColumns(staged).withColumns({new: real_or_null(F.col(new)) for new in columns})


def flag_or_zero(c: Column) -> Column:
    """Text or number to an integer flag; unreadable values count as 0."""
    return F.coalesce(number_or_null(c).try_cast("int"), F.lit(0))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c.cast("double"), digits)


def clamp(c: Column, low: int, high: int) -> Column:
    """Limit to [low, high]; null stays null (least/greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def score_0_10(c: Column) -> Column:
    """Nearest integer (ties to even) limited to 0..10."""
    return clamp(half_even(c), 0, 10).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, null when bottom is 0 or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def add_up(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def band(c: Column, bands: list[tuple[int, str]]) -> Column:
    """Name of the band a score falls in; bands are (lowest score, name)."""
    out = None
    for low, name in sorted(bands, reverse=True):
        out = F.when(c >= low, name) if out is None else out.when(c >= low, name)
    return out


def significance_stars(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
        .when(p.isNotNull(), "ns")
    )


def draw_hash(key: Column, seed: Column | int) -> Column:
    """Hex digest that orders rows at random, the same on every engine."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", key.cast("string"), seed.cast("string")))


def hash_int(digest: Column, start: int, digits: int) -> Column:
    """Integer read from `digits` hex digits (at most 13) of a digest."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
