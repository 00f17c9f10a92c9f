"""Line dedup with a tree of line templates of fixed depth.

A line's place in the tree is its number of words and its leading words, words
with digits standing for any value. Below a leaf, a word that enough lines have
in the same position is fixed, any other is a variable field. The lines of a
leaf with the same fixed words share a template. A template that recurs across
documents is dropped wherever it stands - unless the documents are copies of one
another, which their other lines show: then the template belongs to the text.
Only lines that do not recur themselves tell: boilerplate that stands together
does not make its holders alike, and a document that consists mostly of recurring
lines is no evidence for any template.

Lines are told apart by 60 bits of their md5, words within a leaf by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import store
from riskloom.llm.decontamination import row_key

MIN_DOCS = 10
MIN_WORDS = 3
LEADING = 2
# Of a line's words without digits, so many must be fixed, and at least FIXED_WORDS.
FIXED_SHARE = 0.75
FIXED_WORDS = 2
# Of the different texts with a template, so many must differ in their other lines.
OWN_SURROUNDINGS = 0.5
# A document is evidence when so many of its different lines do not recur.
OWN_LINES = 0.5
_WHITE = r"\x20\x09-\x0D"
_WORD = f"[^{_WHITE}]+"
_PLAIN_WORD = f"(?<![^{_WHITE}])[^{_WHITE}0-9]+(?![^{_WHITE}])"
_LEADING = f"^[{_WHITE}]*" + f"[{_WHITE}]+".join([f"({_WORD})"] * LEADING)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def digest_of(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _single_spaces(line: Column) -> Column:
    """Whether words are parted by single spaces only, so that counting spaces counts words."""
    odd = line.startswith(" ") | line.endswith(" ") | (line == "")
    for white in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(white)
    return ~odd


def _with_leaf(lines: DataFrame) -> DataFrame:
    """With the line's place in the tree; null for lines of too few words.

    Step by step, so that nothing is worked out twice.
    """
    line = F.col("line")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    apart = F.concat_ws(" ", *[F.regexp_extract(line, _LEADING, k + 1) for k in range(LEADING)])
    kept = lines.columns
    counted = lines.withColumn("single", _single_spaces(line)).select(
        *kept, F.when(F.col("single"), spaces + 1).otherwise(F.regexp_count(line, F.lit(_WORD))).alias("n"),
        F.when(F.col("single"), F.substring_index(line, " ", LEADING)).otherwise(apart).alias("leading"),
    )
    masked = F.when(F.col("leading").rlike("[0-9]"), F.regexp_replace("leading", "[^ ]*[0-9][^ ]*", "<*>")).otherwise(F.col("leading"))
    return counted.select(*kept, F.when(F.col("n") >= MIN_WORDS, F.xxhash64("n", masked)).alias("leaf"))


def tree_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, copy, line, leaf: every different line of every document.

    `copy` is the same in documents of equal text.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(row_key(id_col, text_col).alias("doc"), F.xxhash64(text).alias("copy"), F.array_distinct(lines_of(text)).alias("lines"))
    return _with_leaf(rows.select("doc", "copy", F.explode("lines").alias("line")))


def _surroundings(lines: DataFrame, min_docs: int) -> DataFrame:
    """doc, low, high: the least and the greatest digest of the lines that do not recur in
    `min_docs` texts, for documents of which such lines are the larger part."""
    often = store.few(store.written(lines.groupBy("digest").count().where(F.col("count") >= min_docs).select("digest")))
    recurring = (
        lines.join(often, "digest", "left_semi").groupBy("digest").agg(F.count_distinct("copy").alias("n"))
        .where(F.col("n") >= min_docs).select("digest", F.lit(True).alias("recurs"))
    )
    marked = lines.join(store.few(store.written(recurring)), "digest", "left")
    own = F.when(F.col("recurs").isNull(), F.col("digest"))
    each = marked.groupBy("doc").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count(own).alias("own"), F.count("*").alias("all"))
    return each.where(F.col("own") >= OWN_LINES * F.col("all")).select("doc", "low", "high")


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, fixed_share: float) -> DataFrame:
    """digest, template of the different lines that belong to a recurring template."""
    tree = tree_lines(docs, id_col, text_col)
    lines = store.written(tree.select("doc", "copy", digest_of(F.col("line")).alias("digest"), "leaf"))
    busy = lines.where("leaf is not null").groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    # Each different line of a busy leaf once.
    seen = tree.select("leaf", "line").join(store.few(store.written(busy)), "leaf", "left_semi").groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    plain = F.regexp_count("line", F.lit(_PLAIN_WORD))
    different = store.written(seen.select("leaf", "line", "docs", plain.alias("plain"), digest_of(F.col("line")).alias("digest")))
    words = F.regexp_extract_all("line", F.lit(_WORD), F.lit(0))
    placed = different.select("digest", "leaf", "docs", "plain", F.posexplode(words).alias("pos", "word")).where(~F.col("word").rlike("[0-9]"))
    placed = placed.withColumn("word", F.xxhash64("word"))
    fixed = placed.groupBy("leaf", "pos", "word").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "pos", "word")
    of_words = (
        placed.join(fixed, ["leaf", "pos", "word"])
        .groupBy("digest", "leaf", "plain").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("kept"))
        .where((F.size("kept") >= fixed_share * F.col("plain")) & (F.size("kept") >= FIXED_WORDS))
        .select("digest", F.md5(F.to_json(F.struct("leaf", "kept"))).alias("template"))
    )
    # With fewer fixed words a line is a template only as it stands.
    as_it_stands = different.where((F.col("docs") >= min_docs) & (F.col("plain") < FIXED_WORDS)).select("digest", F.col("digest").cast("string").alias("template"))
    template = store.written(of_words.unionByName(as_it_stands))
    around = F.when(F.col("low") != F.col("digest"), F.col("low")).when(F.col("high") != F.col("digest"), F.col("high"))
    held = lines.select("digest", "doc", "copy").join(store.few(template), "digest").join(_surroundings(lines, min_docs), "doc")
    recurring = (
        held.select("template", "copy", around.alias("around")).where("around is not null")
        .groupBy("template").agg(F.count_distinct("copy").alias("n"), F.count_distinct("around").alias("own"))
        .where((F.col("n") >= min_docs) & (F.col("own") >= min_docs) & (F.col("own") >= OWN_SURROUNDINGS * F.col("n")))
        .select("template")
    )
    return template.join(recurring, "template", "left_semi")


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None,
    min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE,
) -> DataFrame:
    """All rows and columns, the text without the lines of recurring templates.

    The other lines keep their order. A text of which nothing stays is empty, a
    null stays null, and rows are never dropped. Lines of fewer than MIN_WORDS
    words are left alone, and so are lines of which no other line of their documents
    tells anything (texts of one line, texts of recurring lines only). With `count_col`,
    that column (replaced if it exists) has the number of dropped lines. Rows equal in
    id and text count as one document. Columns may have any names.
    """
    text = F.col(f"`{text_col}`").cast("string")
    bad = store.written(recurring_lines(docs, id_col, text_col, min_docs, fixed_share).select("digest"))
    lines = docs.select(row_key(id_col, text_col).alias("doc"), F.posexplode(lines_of(text)).alias("at", "line"))
    doc, out = store.new_names(docs, "doc", "cut")
    cut = (
        lines.select("doc", "at", digest_of(F.col("line")).alias("digest")).join(store.few(bad), "digest", "left_semi")
        .groupBy("doc").agg(F.collect_set("at").alias(out)).withColumnRenamed("doc", doc)
    )
    rest = F.array_join(F.filter(lines_of(text), lambda x, i: ~F.array_contains(out, i)), "\n")
    joined = docs.join(store.few(store.written(cut)), row_key(id_col, text_col) == F.col(doc), "left")
    columns = [F.when(F.col(out).isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    if count_col:
        columns.append(F.coalesce(F.size(out), F.lit(0)).cast("long").alias(count_col))
    return joined.select(*columns)
