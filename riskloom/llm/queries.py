"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import (
    conversation_repair, decontamination, fill_in_middle, language_model, line_dedup, ngram_join, quality_classifier, quality_rules, sentence_pieces, sharding, store,
    substring_dedup, token_files, toxicity,
)


# Files of the public tokenizers; every executor has them at the same path.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 1


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that benchmark windows cover, and the items they come from."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    docs = store.named(_table(spark, sf_dir, "documents"), doc_id="doc_id")
    return sharding.place(docs, "doc_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    found = ngram_join.similar_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the files of directly addressable codes give it back."""
    folder = store.shared_folder(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_file(WORD_TOKENIZER), END_ID)
    return token_files.read_tokens(spark, folder, "ids_crc32 long", token_files.crc_of).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by its labelled neighbours."""
    docs = store.named(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    known = _table(spark, sf_dir, "labels").where(store.crc_remainder(F.col("doc_id"), 4) != 2)
    scored = quality_classifier.with_score(docs, quality_classifier.fit(docs, known))
    return _verdict(scored, 4, 2, quality_classifier.KEEP_FROM)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by its most toxic segment."""
    docs = store.named(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    known = _table(spark, sf_dir, "labels").where(store.crc_remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.with_score(docs, toxicity.fit(docs, known))
    return _verdict(scored, 5, 0, toxicity.TOXIC_FROM)


def _verdict(scored: DataFrame, divisor: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", "score").select(
        "doc_id", (store.crc_remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every text and the verdict of the rules."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "votes", F.round("posterior", 6).alias("posterior"),
    )


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text, and whether they decode to it."""
    docs = store.named(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return sentence_pieces.with_round_trip(docs, tokenizer_file(PIECE_MODEL)).select("doc_id", "trip.*")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages to cut, with their places in the original texts."""
    found = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("kept").alias("kept_doc_id"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines of templates that recur across documents."""
    docs = store.named(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return line_dedup.drop_recurring_lines(docs, count_col="n_dropped")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every text by the contexts of the texts to learn from."""
    held_out = store.crc_remainder(F.col("doc_id"), 7) == 2
    scored = language_model.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text arranged for filling in the middle, and put back from that."""
    docs = store.named(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    made = fill_in_middle.with_fim(docs).select("doc_id", "fim")
    back = fill_in_middle.with_restored(made, F.col("fim.output"), F.col("fim.form"))
    facts = ["n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return back.select("doc_id", *[F.col(f"fim.{c}").alias(c) for c in facts], F.col("restored.sha256").alias("restored_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that a digest of conversation and turn calls for."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = store.crc_remainder(F.concat(conv, F.lit(":"), turn), 20)
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = rows.withColumn("kind", kind).where("kind != 0")
    made = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return made.drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    rows = store.named(_table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    repaired = conversation_repair.repair(_damaged(rows)).withColumnRenamed("conv_id", "id")
    ids = rows.select("conv_id").distinct()
    filled = {c: F.lit(0).cast("long") for c in conversation_repair.COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in filled.items()])


QUERIES = {
    f.__name__: f for f in (
        op1_decontamination, op2_sharding, op3_ngram_join, op4_token_files, op5_quality, op6_toxicity,
        op7_quality_rules, op8_sentence_pieces, op9_substring_dedup, op10_line_dedup, op11_language_model, op12_fill_in_middle, op13_conversation_repair,
    )
}
