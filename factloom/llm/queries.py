"""Queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import html, katz, langid, minhash, negatives, packing, prefix_trie, quality, sampling, token_counts, token_files, topk, urls
from factloom.llm.common import remainder, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = remainder("doc_id", 5)
    return langid.identify(docs, learn=part != 0, out="found").select(
        "doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sampling.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 50 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 5)
    return katz.score(docs, held_out=part == 1, train=part != 1)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), is_anchor=F.col("id") % 100 == 0, relabel=negatives.SHIFTED
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_html_extraction": op5_html_extraction,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_token_files": op9_token_files,
    "op10_katz_lm": op10_katz_lm,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op7_quality_rules": quality.QUALITY_SQL,
    "op8_exact_top_k": topk.TOP_K_SQL,
    "op12_prefix_trie": prefix_trie.PREFIX_TRIE_SQL,
    "op13_hard_negatives": negatives.HARD_NEGATIVES_SQL,
}
