"""Registered queries of the text operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweir.llm import katz, language, leakage, licenses, merkle, mixing, pagetext, phrases, quality, sharding, simhash, tokenfile, tokens
from riskweir.llm.common import documents, in_fold
from riskweir.session import scratch


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = in_fold(4, 2)
    found = language.identify(docs, docs.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.prefix_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    found = found.select("doc_id", "n_bytes", tokens.n_tokens().alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), in_fold(7, 2))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenfile.write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(spark, path)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), F.col("doc_id").isNotNull() & in_fold(3, 0))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(documents(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_sharding, op4_katz_score, op5_simhash_dedup, op6_token_file, op7_license_scan, op8_mixing, op9_quality_rules, op10_decontamination,
    op11_phrase_mining, op12_merkle_manifest, op13_html_extraction,
)}
