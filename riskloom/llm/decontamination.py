"""Benchmark decontamination over a positional inverted index.

The index holds one posting (term, document, position) for every word of every
document. Each task writes the postings of its own documents ordered by term, so
building needs no shuffle, a frequent term is never one group, and a reader of
some terms skips the rest. A test passage is looked up by its windows: the
postings of each window's rarest terms, moved back by the term's offset in the
passage, must meet at one place of a document. Only those places are then
compared word by word with the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm import store

WINDOW = 13
LISTS = 2
# Words of raw text: ASCII letters and digits and all that is not ASCII; A-Z are parts of words because they are
# folded afterwards. Written as what it matches: Java runs a negated class of three or more ranges some 15 times slower.
_RAW_WORD = r"[\p{Alnum}\P{ASCII}]+"
_UPPER, _FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """The words of a text in order, letters as written; none for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0)), F.expr("array()"))


def fold(word: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(word, _UPPER, _FOLDED)


def term_of(word: Column) -> Column:
    """The index term of a word. Words that differ beyond A-Z may share one; the comparison decides."""
    return F.xxhash64(F.lower(word))


@dataclass
class PositionalIndex:
    """`postings`: term, doc, pos. `doc` is the row's key: see `row_key`."""

    postings: DataFrame

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, n: how many postings each of the given terms has (those without any are absent)."""
        return self.postings.select("term").join(store.few(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text, so repeated ids and null ids do no harm; rows equal in both
    are one document."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Write the postings of all words of all documents to the shared folder."""
    postings = (
        # Keys in a projection of their own: beside the posexplode each word would take its text's digest anew.
        docs.select(row_key(id_col, text_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
        .select("doc", F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
        .select(term_of(F.col("word")).alias("term"), "doc", "pos")
        .sortWithinPartitions("term")
    )
    return PositionalIndex(store.written(postings, compression="zstd"))


def passages_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(passage, words, m) for each distinct word sequence, and (passage, item) for each item.

    Items without words are left out; a null id is empty text.
    """
    words = F.transform(raw_words(F.col(f"`{text_col}`").cast("string")), fold)
    both = store.written(
        items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words.alias("words"))
        .where("size(words) > 0").select(F.xxhash64("words").alias("passage"), "item", "words")
    )
    passages = both.groupBy("passage").agg(F.first("words").alias("words")).withColumn("m", F.size("words"))
    return store.written(passages), both.select("passage", "item").distinct()


def _rarest(index: PositionalIndex, passages: DataFrame, window: int, lists: int) -> DataFrame:
    """passage, term, off, need: where each window's rarest terms stand in the passage.

    Windows with a word that the corpus has nowhere are left out.
    """
    terms = passages.select("passage", "m", F.posexplode("words").alias("off", "word")).withColumn("term", term_of(F.col("word")))
    counts = index.frequencies(store.written(terms.select("term").distinct()))
    starts = (
        terms.join(counts, "term", "left")
        .withColumn("start", F.explode(F.expr(f"sequence(greatest(0, off - {window - 1}), least(off, greatest(0, m - {window})))")))
    )
    in_window = Window.partitionBy("passage", "start")
    order = in_window.orderBy("n", "term", "off")
    chosen = (
        starts.withColumn("known", F.count("n").over(in_window)).withColumn("words_in", F.count("*").over(in_window))
        .where("known = words_in").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lists)
    )
    return chosen.select("passage", "term", "off", F.least(F.lit(lists), "m").alias("need")).distinct()


def phrase_matches(
    index: PositionalIndex, docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, lists: int = LISTS,
) -> DataFrame:
    """doc, passage, hits: every place where a document holds `window` consecutive words of a
    passage (all words of a shorter one); `hits` are the document's word positions there.

    Places that overlap, repeat or stand in copies are all found.
    """
    anchors = store.written(_rarest(index, passages, window, lists))
    places = (
        index.postings.join(store.few(anchors), "term")
        .groupBy("doc", "passage", (F.col("pos") - F.col("off")).alias("shift"))
        .agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need")
        .select("doc", "passage", "shift")
    )
    places = store.written(places.join(store.few(passages), "passage"))
    rows = docs.select(row_key(id_col, text_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    aligned = (
        rows.join(store.few(places), "doc")
        .withColumn("begin", F.greatest(F.lit(0), "shift").cast("int"))
        .withColumn("lead", (F.col("begin") - F.col("shift")).cast("int"))
        .select(
            "doc", "passage", "begin", F.least(F.lit(window), "m").alias("width"),
            F.slice(raw_words(F.col("__text")), F.col("begin") + 1, F.col("m") - F.col("lead")).alias("there"),
            F.slice("words", F.col("lead") + 1, F.col("m") - F.col("lead")).alias("wanted"),
        )
    )
    starts = F.expr(
        "CASE WHEN size(there) >= width THEN filter(sequence(0, size(there) - width), "
        f"s -> transform(slice(there, s + 1, width), w -> translate(w, '{_UPPER}', '{_FOLDED}')) = slice(wanted, s + 1, width)) "
        "ELSE cast(array() AS array<int>) END"
    )
    # Exploding one array of starts keeps the filter behind it, so words are read once.
    return (
        aligned.select("doc", "passage", "begin", "width", F.explode(F.array(starts)).alias("starts")).where("size(starts) > 0")
        .select("doc", "passage", F.expr(
            "array_distinct(flatten(transform(starts, s -> sequence(begin + s, begin + s + width - 1))))"
        ).alias("hits"))
    )


def near_matches(index: PositionalIndex, passages: DataFrame, reach: int) -> DataFrame:
    """doc, passage, first, last: places where all different terms of a passage stand within `reach`
    words of its rarest term, in any order.

    Positions are cut into strips of `reach` words, so a place meets only postings
    of its own document and of neighbouring strips.
    """
    terms = passages.select("passage", F.explode("words").alias("word")).select("passage", term_of(F.col("word")).alias("term")).distinct()
    terms = store.written(terms)
    counts = index.frequencies(store.written(terms.select("term").distinct()))
    ranked = terms.join(counts, "term", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("passage").orderBy(F.coalesce("n", F.lit(0)), "term"))
    )
    sized = ranked.groupBy("passage").agg(F.count("*").alias("terms"))
    ranked = store.written(ranked.join(sized, "passage"))
    strip = lambda pos: F.floor(pos / reach)
    rare = store.few(store.written(ranked.where("rank = 1").select("passage", "term", "terms")))
    places = (
        index.postings.join(rare, "term").select("passage", "terms", "doc", F.col("pos").alias("at"))
        .withColumn("strip", F.explode(F.array(*[strip(F.col("at")) + i for i in (-1, 0, 1)])))
    )
    rest = store.few(store.written(ranked.where("rank > 1").select("passage", "term")))
    others = index.postings.join(rest, "term").withColumn("strip", strip(F.col("pos")))
    met = (
        others.join(places, ["passage", "doc", "strip"]).where(F.abs(F.col("pos") - F.col("at")) <= reach)
        .groupBy("passage", "doc", "at", "terms")
        .agg(F.count_distinct("term").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).where("n = terms - 1")
    )
    alone = places.where("terms = 1").select("passage", "doc", "at", F.col("at").alias("low"), F.col("at").alias("high")).distinct()
    return met.select("passage", "doc", "at", "low", "high").unionByName(alone).select(
        "doc", "passage", F.least("at", "low").alias("first"), F.greatest("at", "high").alias("last")
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, lists: int = LISTS,
) -> DataFrame:
    """id, doc, n_words, n_hit, n_items, items (their ids, sorted as strings) for every row.

    Null and empty texts have no words. Rows that repeat id and text each get the
    same figures. Without items, or without documents, nothing is hit.
    """
    index = build_index(docs, id_col, text_col)
    passages, members = passages_of(items, item_id_col, item_text_col)
    found = store.written(phrase_matches(index, docs, passages, id_col, text_col, window, lists))
    hit = found.select("doc", F.explode("hits").alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    named = (
        found.select("doc", "passage").distinct().join(members, "passage").select("doc", "item").distinct()
        .groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    sizes = index.postings.groupBy("doc").agg((F.max("pos") + 1).cast("long").alias("n_words"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("doc"))
    facts = store.written(hit.join(named, "doc"))
    return (
        rows.join(sizes, "doc", "left").join(store.few(facts), "doc", "left")
        .select(
            "id", "doc", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"),
        )
    )


def contaminated() -> Column:
    """Hit at all, and in at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are not contaminated, all columns as they were."""
    (own,) = store.new_names(docs, "doc")
    judged = contamination(docs, items, id_col, text_col, **options).where(contaminated()).select(F.col("doc").alias(own))
    bad = store.written(judged.distinct())
    return docs.join(store.few(bad), row_key(id_col, text_col) == F.col(own), "left_anti")
