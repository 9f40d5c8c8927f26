"""The queries of this subpackage: one ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, language_id, near_dedup, oracles, packing, quality_rules, secret_scan, substring_dedup, toxicity
from .shared import materialize, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflict = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(conflict).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_conversations(rows)
    learned = made.withColumn("learned", chat_format.learned_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return learned.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.*")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.learn(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict, which = quality_rules.apply_rules(quality_rules.learn(docs, labels))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.text_statistics(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts],
        quality_rules.base_failed().alias("base_failed"), verdict.alias("kept"), which.alias("rule"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeats(docs, texts=False).drop("kept_text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two increments: a part of the rows with the base rules alone, then all rows with all rules, of which the ledger has some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0)
    ledger = materialize(secret_scan.scan(earlier, rules=tuple(r for r in secret_scan.RULES if r.base)))
    ledger = ledger.union(materialize(secret_scan.scan(docs, ledger)))
    spans = F.col("spans")
    return secret_scan.locate(docs, ledger).select(
        "doc_id",
        *[secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.written(spans, True), 256).alias("base_sha256"),
        secret_scan.written(spans, False).alias("spans"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "longest_words")
    return found.select("doc_id", *[F.col(f"leaks.{c}").alias(c) for c in columns], (F.col("leaks.n_hit") > 0).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), chain)
    return found.select("doc_id", "toxicity.*", (F.col(f"toxicity.{toxicity.TARGET}") >= 0.5).alias("is_toxic"))


def queries() -> dict:
    return {
        "op9_toxicity": op9_toxicity,
        "op10_decontaminate": op10_decontaminate,
        "op1_chat_format": op1_chat_format,
        "op2_near_dedup": op2_near_dedup,
        "op3_language_id": op3_language_id,
        "op4_html_extract": op4_html_extract,
        "op5_packing": op5_packing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op6_quality_rules": op6_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force."""
    return {"op1_chat_format": oracles.CHAT, "op8_secret_scan": oracles.SECRETS, "op10_decontaminate": oracles.LEAKS}
