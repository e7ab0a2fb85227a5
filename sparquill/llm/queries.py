"""Queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, gear, html, packing, simhash, sketch, topk, toxicity, warc


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The vocabulary that sequences are packed with, and its special token.
PACK_VOCABULARY, PACK_SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_planted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.read_back(chat.examples(turns))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gear.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("repeat_spans").cast("long").alias("n_repeats"), F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("repeat_chars"), "repeat_spans")


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(PACK_VOCABULARY), PACK_SPECIAL)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_stop", "worst_score", "offending")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ORACLE, "op6_warc": warc.ORACLE, "op8_exact_top_k": topk.ORACLE}
