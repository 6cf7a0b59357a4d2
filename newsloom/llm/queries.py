"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import byte_bpe, decontaminate, exact_dedup, langid_ppm, license_scan, page_differencing, sharding, simhash, spelling_variants, substring_dedup, suffix_tree_lm, token_alignment, toxicity_zstd
from newsloom.llm.common import documents, remainder

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity_zstd.toxicity(docs, docs.select("doc_id", "text").join(labels, "doc_id"))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.classes(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return suffix_tree_lm.scores(docs, remainder("doc_id", 10) != 0).withColumn("held_out", remainder("doc_id", 10) == 0)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid_ppm.identify(docs, docs.where(remainder("doc_id", 4) != 2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.round("bits_per_byte", 4).alias("bits_per_byte"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_differencing.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_byte_bpe, op4_substring_dedup, op5_simhash, op6_exact_dedup, op7_sharding, op8_suffix_tree_lm, op9_langid, op10_license_scan, op11_token_alignment, op12_main_text, op13_spelling_variants)}
ORACLE_SQL = {"op2_decontaminate": decontaminate.SQL, "op6_exact_dedup": exact_dedup.SQL, "op7_sharding": sharding.SQL, "op13_spelling_variants": spelling_variants.SQL}
