"""Jaccard self-join of documents by blocked sparse products of their n-gram incidence.

Documents with the same set of n-grams are one class. Every class shows the first
fifth of its n-grams, in hash order but with common ones last (those of lines that
many texts have); of these the rarest are kept, so many that two classes similar
enough must still have one in common (the bounds follow from their sizes). Classes
that meet there form groups if sizes in between lead from one to the other by steps
that a link allows; nothing similar lies in two groups. A group is cut into blocks of
bounded size by set size, and each pair of blocks whose sizes allow a link is one
sparse join: rows that share one of their rarest n-grams are compared, unless they
hang together already, and a spanning forest of the links goes on. Groups of more
than a block are first broken by what their sets show alone; whole sets within what
remains decide. No pairs are listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.llm import store
from riskloom.llm.bytes_np import shingle_hashes, word_hashes
from riskloom.llm.components import components

WIDTH = 4
PERCENT = 85
SHOWN = 0.2
BLOCK_NGRAMS = 800_000
# Groups are dealt to this many blocks' worth of n-grams per task at least.
PACK_NGRAMS = 200_000
# Which n-grams are common is told by so many n-grams of texts chosen by hash, and at most so many come last. This
# settles only an order of n-grams that all texts share; any order gives the same links.
COUNTED_NGRAMS, COMMON_NGRAMS = 16_000_000, 1_000_000
# Steps of size in which classes meet, to a step of the sizes that links allow.
STEPS = 4


def ngram_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's different n-grams; empty without words."""
    return np.unique(shingle_hashes(word_hashes(text), width))


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The smallest overlap at which sets of these sizes are linked."""
    return -(-percent * (a + b) // (100 + percent))


def shown(n: int) -> int:
    """How many n-grams, the first in the order of all n-grams, a set of n shows."""
    return min(n, math.floor(SHOWN * n) + 1)


def sure_overlap(n: int, percent: int = PERCENT) -> int:
    """How many shown n-grams a set of n must share with any set it is linked with.

    Of the n-grams two linked sets share, at most (size - shown) of the set whose
    last shown n-gram comes first in the order can lie behind both shown parts.
    Partners have between percent/100 and 100/percent times the size; the bound
    moves by whole steps at both ends, so a few units are given away for rounding.
    """
    small = -(-percent * n // 100)
    large = 100 * n // percent
    hidden = lambda m: m - shown(m)
    bounds = (least_overlap(n, m, percent) - max(hidden(n), hidden(m)) for m in (small, n, large))
    return max(1, min(bounds) - 2)


def needed_overlaps(a: int, sizes: np.ndarray, percent: int, only_shown: bool) -> np.ndarray:
    """The smallest overlap of a set of size a with each of the other sizes at which they
    are, or by what they show may be, linked. More than both have where sizes forbid a link."""
    least = -(-percent * (a + sizes) // (100 + percent))
    if not only_shown:
        return least
    hidden = sizes - np.minimum(sizes, np.floor(SHOWN * sizes).astype(np.int64) + 1)
    return np.where(least > np.minimum(a, sizes), least, np.maximum(1, least - np.maximum(a - shown(a), hidden)))


def first_shown(ngrams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What a set shows: its first n-grams by hash, those of the sorted `common` (hashes, places) after all others by place."""
    hashes, places = common
    if not len(hashes):
        return ngrams[: shown(len(ngrams))]
    at = np.minimum(np.searchsorted(hashes, ngrams), len(hashes) - 1)
    last = hashes[at] == ngrams
    # The set is in hash order already.
    return np.concatenate([ngrams[~last], ngrams[last][np.argsort(places[at[last]], kind="stable")]])[: shown(len(ngrams))]


def _digest(ngrams: np.ndarray) -> bytes:
    return hashlib.blake2b(ngrams.tobytes(), digest_size=16).digest()


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, digest, n of every row, ids as they are."""

    @F.pandas_udf("digest binary, n long")
    def sized(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [ngram_set(t, width) for t in texts]
            yield pd.DataFrame({"digest": [_digest(s) for s in sets], "n": np.array([len(s) for s in sets], np.int64)})

    rows = store.named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return store.written(rows.select("id", sized("text").alias("set")).select("id", "set.*"))


def _representatives(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text of the row that stands for each class with n-grams (a repeated id may bring several)."""
    chosen = store.written(classes.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id")).select("id").distinct())
    rows = store.named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(store.few(chosen), "id", "left_semi")


def _common_ngrams(representatives: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in their order, place of each by frequency) of n-grams that several of some texts chosen by hash have."""
    share = max(1, math.ceil(total / COUNTED_NGRAMS))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in store.pieces(batches):
            sets = [ngram_set(t, width).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"ngram": np.concatenate(sets) if sets else np.zeros(0, np.int64)})

    chosen = representatives.where(F.pmod(F.xxhash64("id", F.lit("counted")), F.lit(share)) == 0)
    counts = chosen.select("text").mapInPandas(listed, "ngram long").groupBy("ngram").agg(F.count("*").alias("df")).where("df > 1")
    # At most COMMON_NGRAMS rows come to the driver, in a table of two numbers.
    found = store.written(counts.orderBy(F.desc("df"), "ngram").limit(COMMON_NGRAMS)).toArrow()
    hashes = found["ngram"].to_numpy().view(np.uint64)
    places = np.lexsort((hashes, found["df"].to_numpy())).argsort().astype(np.int32)
    by = np.argsort(hashes)
    return hashes[by], places[by]


def _shown_ngrams(representatives: DataFrame, width: int, common) -> DataFrame:
    """id, n, ngram for the shown n-grams; `common` is broadcast."""

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in store.pieces(batches):
            sets = [ngram_set(t, width) for t in batch["text"]]
            parts = [first_shown(s, common.value) for s in sets]
            counts = [len(p) for p in parts]
            yield pd.DataFrame({
                "id": np.repeat(batch["id"].to_numpy(np.int64), counts),
                "n": np.repeat(np.array([len(s) for s in sets], np.int32), counts),
                "ngram": np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64),
            })

    return representatives.mapInPandas(show, "id long, n int, ngram long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of n-grams that stand in more than one row."""
    several = rows.groupBy("ngram").agg(F.count("*").alias("df")).where("df > 1").select("ngram")
    return rows.join(several, "ngram", "left_semi").select("id", "n", "ngram")


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Edges a, b between each class and the smallest class it meets at each n-gram it keeps.

    Classes meet at an n-gram if steps of size that links allow lead from one to the other over
    classes that have it too. Linked ones meet at all n-grams that both show.
    """
    step = F.floor(F.log(F.col("n").cast("double")) * (STEPS / math.log(100 / percent))).cast("int")
    rows = rows.withColumn("step", step)
    # One row per n-gram and step, so that no n-gram's classes are ever together.
    spots = rows.groupBy("ngram", "step").agg(
        F.count("*").alias("held"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("n").alias("small"), F.max("n").alias("large")
    )
    along = W.partitionBy("ngram").orderBy("step")
    apart = F.coalesce((percent * F.col("small").cast("long") > 100 * F.lag("large").over(along)).cast("int"), F.lit(0))
    run = W.partitionBy("ngram", "run")
    met = (
        spots.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along))
        .select("ngram", "step", F.sum("held").over(run).alias("df"), F.min("low").over(run).alias("hub"), F.max("high").over(run).alias("other"))
        .where("hub < other").drop("other")
    )
    seen = rows.join(met, ["ngram", "step"]).select("id", "n", F.struct("df", "ngram", "hub").alias("at"))

    @F.pandas_udf("int")
    def dropped(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda n: sure_overlap(int(n), percent) - 1).astype("int32")

    kept = (
        seen.groupBy("id", "n").agg(F.sort_array(F.collect_list("at"), asc=False).alias("at"))
        .withColumn("drop", dropped("n"))
        .select("id", F.explode(F.expr("array_distinct(transform(slice(at, drop + 1, size(at)), x -> x.hub))")).alias("hub"))
    )
    return kept.select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _size_class(n: Column, percent: int) -> Column:
    """Sets linked with each other lie in the same or in neighbouring classes of size."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _tasks(grouped: DataFrame, percent: int, share: float) -> DataFrame:
    """id, task: where each class goes. `grouped` has id, n, component; `share` of its
    n-grams go there."""
    grouped = grouped.withColumn("m", F.col("n") * share)
    sized = grouped.withColumn("size", _size_class(F.col("n"), percent))
    totals = grouped.groupBy("component").agg(F.sum("m").alias("total"), F.count("*").alias("members")).where("members > 1")
    all_ngrams = grouped.agg(F.sum("m")).first()[0] or 0
    packs = max(1, math.ceil(all_ngrams / PACK_NGRAMS))
    whole = totals.where(F.col("total") <= BLOCK_NGRAMS).select("component", F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(packs))).alias("task"))
    small = sized.join(whole, "component").select("id", "task")
    large = totals.where(F.col("total") > BLOCK_NGRAMS).select("component")
    rows = store.written(sized.join(large, "component").select("id", "m", "component", "size"))
    layers = rows.groupBy("component", "size").agg(F.greatest(F.lit(1), F.ceil(F.sum("m") / (BLOCK_NGRAMS / 2))).cast("int").alias("blocks"))
    mine = rows.join(layers, ["component", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each block meets the blocks of its own layer and of the layers next to it.
    near = layers.select("component", F.explode(F.array(*[F.col("size") + i for i in (-1, 0, 1)])).alias("size"), F.col("size").alias("their"), F.col("blocks").alias("theirs"))
    pairs = (
        mine.join(near, ["component", "size"])
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
        .withColumn("one", F.struct("size", "block")).withColumn("two", F.struct(F.col("their").alias("size"), F.col("partner").alias("block")))
        .select("id", F.concat_ws("/", F.lit("b"), "component", F.to_json(F.least("one", "two")), F.to_json(F.greatest("one", "two"))).alias("task"))
    )
    return small.unionByName(pairs)


def _firsts(sizes: np.ndarray, lengths: np.ndarray, percent: int, only_shown: bool) -> np.ndarray:
    """How many of a set's entries, rarest first, must hold one that a linked set has among its own."""
    if only_shown:
        sure = {n: sure_overlap(n, percent) for n in np.unique(sizes).tolist()}
        least = np.array([sure[n] for n in sizes.tolist()], np.int64)
    else:
        least = -(-percent * sizes // 100)
    return lengths - np.minimum(lengths, least) + (lengths > 0)


def forest(
    ids: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray | None = None, percent: int = PERCENT, only_shown: bool = False,
) -> list[tuple[int, int]]:
    """A spanning forest of the links among the given sets, as pairs of ids. `sizes` are
    those of the whole sets where only the shown n-grams are given.

    Linked sets share one of the first of their n-grams, rarest first; how many of these
    follows from the overlap a link needs. A row is compared with the later rows it meets
    there that do not hang together with it already. Rows that share none cost nothing.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    sizes = lengths if sizes is None else np.asarray(sizes, np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, lengths = sizes[order], lengths[order]
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    # N-grams as numbers, rarest first.
    _, number, held = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(held), np.int64)
    place[np.argsort(held, kind="stable")] = np.arange(len(held))
    owner, number = np.repeat(np.arange(len(order)), lengths), place[number]
    by = np.lexsort((number, owner))
    number, alone = number[by], np.sort(held, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    within = np.arange(len(number)) - np.repeat(starts[:-1], lengths)
    first = (within < np.repeat(_firsts(sizes, lengths, percent, only_shown), lengths)) & (alone[number] > 1)
    # The rows that have an n-gram among their first ones, side by side and ascending; and of each entry, the later rows.
    column, row_of = number[first], owner[first]
    across = np.argsort(column, kind="stable")
    column, row_of = column[across], row_of[across]
    ends = np.searchsorted(column, column, side="right")
    back = np.argsort(row_of, kind="stable")
    at = np.searchsorted(row_of[back], np.arange(len(order) + 1))
    # Rows with one label hang together.
    label, members = np.arange(len(order)), {}
    found = []
    for row in range(len(order)):
        entries = back[at[row] : at[row + 1]]
        counts = ends[entries] - entries - 1
        total = int(counts.sum())
        if not total:
            continue
        spots = np.repeat(entries + 1 - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
        met = row_of[spots]
        met = np.unique(met[label[met] != label[row]])
        if not len(met):
            continue
        needed = needed_overlaps(int(sizes[row]), sizes[met], percent, only_shown)
        possible = needed <= np.minimum(lengths[row], lengths[met])
        met, needed = met[possible], needed[possible]
        mine = number[starts[row] : starts[row + 1]]
        while len(met):
            # As many as hold a bounded number of n-grams; the most alike sizes come first.
            some = max(1, int(np.searchsorted(np.cumsum(lengths[met]), 64 * len(mine), side="right")))
            some, met, bound, needed = met[:some], met[some:], needed[:some], needed[some:]
            whose = np.repeat(np.arange(len(some)), lengths[some])
            theirs = number[np.concatenate([np.arange(starts[r], starts[r + 1]) for r in some])]
            spot = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            overlap = np.bincount(whose[mine[spot] == theirs], minlength=len(some))
            for other in some[overlap >= bound].tolist():
                a, b = int(label[row]), int(label[other])
                if a != b:
                    # The smaller family takes the label of the larger.
                    if len(members.get(a, (a,))) < len(members.get(b, (b,))):
                        a, b = b, a
                    moved = members.pop(b, [b])
                    label[moved] = a
                    members.setdefault(a, [a]).extend(moved)
                    found.append((int(ids[order[row]]), int(ids[order[other]])))
            rest = label[met] != label[row]
            met, needed = met[rest], needed[rest]
    return found


def _links(representatives: DataFrame, tasks: DataFrame, width: int, percent: int, common=None) -> DataFrame:
    """Edges a, b of the forests of all tasks; of what sets show alone if `common` is given."""
    only_shown = common is not None
    texts = representatives.join(store.few(tasks), "id")

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in store.pieces(batches):
            sets = [ngram_set(t, width).view(np.int64) for t in batch["text"]]
            sizes = [len(s) for s in sets]
            kept = [first_shown(s.view(np.uint64), common.value).view(np.int64) for s in sets] if only_shown else sets
            yield pd.DataFrame({"task": batch["task"].to_numpy(), "id": batch["id"].to_numpy(), "n": sizes, "ngrams": kept})

    def product(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in batch["ngrams"]]
        found = forest(batch["id"].to_numpy(), sets, batch["n"].to_numpy(), percent, only_shown)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    sets = texts.select("task", "id", "text").mapInPandas(as_sets, "task string, id long, n long, ngrams array<long>")
    return sets.groupBy("task").applyInPandas(product, "a long, b long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
) -> DataFrame:
    """id, n, component of every row: the number of its different n-grams and the smallest
    id reachable by links, itself included.

    Two sets are linked when 100 * overlap >= percent * union. Texts without words
    (nulls, empty ones) are linked with nothing. Rows that repeat an id are one
    document: each has its own n, and the links of any of them count. A row
    without an id takes part in no link; its component is null. Sets are compared
    by 64-bit hashes of their n-grams.
    """
    classes = _classes(docs, id_col, text_col, width)
    reps = _representatives(docs, classes, id_col, text_col)
    ids = classes.where("n > 0 and id is not null")
    stands = ids.groupBy("digest").agg(F.min("id").alias("rep"))
    sizes = ids.groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    common = docs.sparkSession.sparkContext.broadcast(_common_ngrams(reps, total, width))
    with store.written_for_now(_shown_ngrams(reps, width, common)) as rows:
        shared = store.written(_shared(rows))
    meetings = store.written(_meetings(shared, percent).distinct())
    grouped = store.written(components(meetings).withColumnRenamed("node", "id").join(sizes, "id"))
    totals = grouped.groupBy("component").agg(F.sum("n").alias("total"))
    large = store.written(totals.where(F.col("total") > BLOCK_NGRAMS).select("component"))
    if large.count():
        loose = grouped.join(store.few(large), "component", "left_semi")
        shown_links = store.written(_links(reps, store.written(_tasks(loose, percent, SHOWN)), width, percent, common))
        broken = components(shown_links).withColumnRenamed("node", "id").join(sizes, "id")
        kept = grouped.join(store.few(large), "component", "left_anti")
        grouped = store.written(kept.select("id", "component", "n").unionByName(broken.select("id", "component", "n")))
    links = store.written(_links(reps, store.written(_tasks(grouped, percent, 1.0)), width, percent))
    common.unpersist()
    same = ids.join(stands, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # Copies hang on their class; only an id with several texts joins classes by itself.
    several = ids.groupBy("id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1").select(F.col("id").alias("a"))
    joined = components(store.written(links.unionByName(same.join(several, "a", "left_semi"))))
    placed = classes.join(stands, "digest", "left")
    placed = placed.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")))
    return placed.select("id", "n", own.alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest id of every component, all columns as they were.

    Rows without words and rows without an id all stay; rows that repeat both id and
    text are one document, of which one row stays.
    """
    found = similar_components(docs, id_col, text_col, **options)
    (own,) = store.new_names(docs, "id")
    copies = store.written(found.where("n > 0 and id is not null and id != component").select(F.col("id").alias(own)).distinct())
    rest = docs.join(store.few(copies), F.col(f"`{id_col}`") == F.col(own), "left_anti")
    return rest
