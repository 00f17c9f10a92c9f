"""Renames, type coercion and text rendering of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import fixed
from riskloom.functions.columns import flag_or_zero, strip, with_numbers


def normalize_target(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    """Accept either label name and return the table with `label`."""
    if label in df.columns:
        return df
    for name in (fixed.LABEL, fixed.LABEL_ALIAS):
        if name in df.columns:
            return df.withColumnRenamed(name, label)
    raise ValueError(f"label column '{label}' not found")


def coerce_flags(df: DataFrame, flags: list[str] = fixed.FLAGS) -> DataFrame:
    return df.withColumns({c: flag_or_zero(F.col(c)) for c in flags if c in df.columns})


def coerce_scores(df: DataFrame, scores: list[str] = fixed.SCORES) -> DataFrame:
    return with_numbers(df, {c: c for c in scores if c in df.columns})


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the missing ones of {name: type} as nulls."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    )


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def strip_sensitive(
    df: DataFrame, label: str = fixed.LABEL, keep_key: str | None = None
) -> DataFrame:
    """Drop label columns, and the record id unless kept, before scoring."""
    hidden = {label, fixed.LABEL, fixed.LABEL_ALIAS, fixed.KEY} - {keep_key}
    return df.drop(*hidden)


def rendered(df: DataFrame, fields=fixed.RENDER_FIELDS, cut: int = fixed.RENDER_CUT) -> Column:
    """`Label: value` lines for the fields present; blank values leave no line."""
    hidden = {fixed.LABEL, fixed.LABEL_ALIAS, fixed.KEY}
    lines = []
    for label, name in fields:
        if name in hidden or name not in df.columns:
            continue
        value = strip(F.col(name).cast("string"))
        shown = value.isNotNull() & ~F.lower(value).isin("", "nan", "none")
        lines.append(F.when(shown, F.concat(F.lit(f"{label}: "), F.substring(value, 1, cut))))
    return F.concat_ws("\n", *lines)


def render_posting(df: DataFrame, key: str, out: str = "posting_text") -> DataFrame:
    return df.select(key, rendered(df).alias(out))


def combined_text(columns: list[str] = fixed.TEXT_COLUMNS) -> Column:
    """Text columns joined by one space; a null still leaves its separator."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def combined_text_sep(
    columns: list[str] = fixed.TEXT_COLUMNS, separator: str = " [SEP] "
) -> Column:
    """Stripped non-blank text columns joined by the separator."""
    parts = [strip(F.col(c).cast("string")) for c in columns]
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def education_group(c: Column) -> Column:
    """Map education names; unknown names stay as they are, null stays null."""
    table = F.create_map(*[F.lit(v) for pair in fixed.EDUCATION_MAP.items() for v in pair])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c), c))


def label_list(c: Column, missing: str = fixed.MISSING) -> Column:
    """Comma-separated labels as an array; nothing usable gives [missing]."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(c.isNull() | (F.size(parts) == 0), F.array(F.lit(missing))).otherwise(parts)
