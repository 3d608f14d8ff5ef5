"""One query for each operator, over its whole table; digests derive from what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm import align, chat, decontaminate, line_dedup, lm, media, merkle, minhash, oracles, packing, quality, rules, sharding, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("example.org/en/1", "block"),
             urls.Rule("com/fr/", "allow"), urls.Rule("com/de/", "block")]
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    chats = chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    back = F.transform(chat.stretches(F.col("formatted")), chat.read_back)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chats.select("conv_id", "formatted", back.alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"), "expanded_tokens")
    return learned.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                          F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                          F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), added=True)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_png(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = media.from_png(stored.drop("text"))
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                       F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256",
                       F.lower(F.hex("feature")).alias("feature"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "items")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return lm.score(_table(spark, sf_dir, "documents"), learn)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    altered = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]
    return merkle.verify(docs, altered=altered, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_best_fit": op3_best_fit,
    "op4_sharding": op4_sharding,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_media": op7_media,
    "op8_decontaminate": op8_decontaminate,
    "op9_lm_score": op9_lm_score,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
