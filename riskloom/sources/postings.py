"""Reading record tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import fixed
from riskloom.operators.clean import normalize_target
from riskloom.sources.split_csv import read_split_csv

# Types of the known columns; all others stay text.
TYPES = {
    "job_id": "bigint",
    **dict.fromkeys(["telecommuting", "has_company_logo", "has_questions"], "int"),
    **dict.fromkeys(
        [
            "qcew_annual_avg_emplvl", "qcew_avg_annual_pay",
            "qcew_oty_annual_avg_emplvl_chg", "qcew_oty_annual_avg_emplvl_pct_chg",
        ],
        "double",
    ),
    fixed.LABEL: "int",
    fixed.LABEL_ALIAS: "int",
    **dict.fromkeys(fixed.FLAGS, "int"),
    **dict.fromkeys(fixed.SCORES, "double"),
}


def read_text_csv(
    spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True
) -> DataFrame:
    """CSV with a header, all columns as text.

    Quoted line breaks need `multi_line`; a file is read by many tasks either way.
    """
    plain = (
        spark.read.option("header", True).option("encoding", encoding)
        .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .csv(path)
    )
    return read_split_csv(spark, path, plain.columns, encoding) if multi_line else plain


def typed(df: DataFrame) -> DataFrame:
    """Give the known columns their types; whole numbers may be written `1.0`."""
    casts = {}
    for name, kind in TYPES.items():
        if name in df.columns:
            number = F.col(name).try_cast("double")
            number = F.when(~F.isnan(number), number)
            casts[name] = F.col(name).try_cast(kind) if kind == "bigint" else number.try_cast(kind)
            if kind == "bigint":
                casts[name] = F.coalesce(casts[name], number.try_cast(kind))
    return df.withColumns(casts)


def read_postings(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = True
) -> DataFrame:
    """The record table with explicit types and the label under one name."""
    df = typed(read_text_csv(spark, path, encoding, multi_line))
    has_label = {fixed.LABEL, fixed.LABEL_ALIAS} & set(df.columns)
    return normalize_target(df) if has_label else df


def read_csv_fallback(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8, or Latin-1 when the file is not valid UTF-8.

    The bytes decide: a valid file may hold U+FFFD. The search stops at the
    first line that cannot be decoded.
    """
    lines = spark.read.text(path)
    damaged = bool(lines.where(~F.is_valid_utf8("value")).take(1))
    return read_text_csv(spark, path, "ISO-8859-1" if damaged else "UTF-8")
