"""The named queries of this folder: one per operator, and the pipeline over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import audit, bpe, chat, html, imi, minhash, mixing, resample, sharding, syncmers, templates, tokenfiles, toxicity
from tallyhouse.sources.tables import read_tables

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_tables(spark, sf_dir)["documents"], bpe.public_path(WORD_VOCABULARY))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_tables(spark, sf_dir)["documents"].select("doc_id", "text")
    kept = templates.drop_recurring_lines(docs, dropped_col="dropped")
    return kept.select("doc_id", F.size("dropped").alias("n_dropped"), "text")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_tables(spark, sf_dir)["documents"])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read_tables(spark, sf_dir)["pages"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_tables(spark, sf_dir)
    return toxicity.toxicity(t["documents"], t["labels"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_mix(read_tables(spark, sf_dir)["documents"])


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(read_tables(spark, sf_dir)["documents"].select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.counted(read_tables(spark, sf_dir)["documents"], bpe.public_path(BYTE_VOCABULARY))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read_tables(spark, sf_dir)["documents"])


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_tables(spark, sf_dir)["embeddings"].select("vec_id", "embedding")
    return imi.search(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_probe(read_tables(spark, sf_dir)["conversations"])))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_tables(spark, sf_dir)
    return resample.resampled(t["documents"].select("doc_id", "text"), t["benchmark"])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_tables(spark, sf_dir)
    return audit.audit(t["documents"], t["labels"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_line_templates": op3_line_templates,
    "op4_sharding": op4_sharding,
    "op5_minhash": op5_minhash,
    "op6_main_text": op6_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_multi_index": op8_multi_index,
    "op9_mixing": op9_mixing,
    "op10_syncmers": op10_syncmers,
    "op11_chat": op11_chat,
    "op12_resample": op12_resample,
    "op13_filter_audit": op13_filter_audit,
}
SQL: dict[str, str] = {
    "op3_line_templates": templates.SQL,
    "op4_sharding": sharding.SQL,
    "op11_chat": chat.SQL,
    "op12_resample": resample.SQL,
    "op13_filter_audit": audit.SQL,
}
