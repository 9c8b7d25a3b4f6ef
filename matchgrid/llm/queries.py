"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, divergence, hard_negatives, language_crf, line_dedup, lm_trie, near_dup, oracle, pii, quality_mil, quality_rules, secrets, token_files
from .common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_verdicts(docs).drop("char_distance", "word_distance")


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    index = token_files.write_token_files(read_table(spark, sf_dir, "documents"), tokenizer, public_tokenizers.PATTERN, end_id=2)
    return token_files.read_token_files(index)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    words = secrets.corpus_words(docs)
    trees = secrets.train(secrets.example_findings(spark, dictionary=words), dictionary=words)
    return secrets.secret_scan(docs, trees, dictionary=words)


def op9_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.lm_scores(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows, label, F.col("id") % 50 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.languages(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_mil": op3_quality_mil,
    "op4_near_dup": op4_near_dup,
    "op5_pii": op5_pii,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_files": op7_token_files,
    "op8_secrets": op8_secrets,
    "op9_lm_trie": op9_lm_trie,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_language_crf": op13_language_crf,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": oracle.quality_rules(),
    "op4_near_dup": oracle.near_dup(),
    "op6_decontaminate": oracle.contamination(),
    "op11_hard_negatives": oracle.hard_negatives(),
    "op12_source_divergence": oracle.source_divergence(),
}
