"""The corpus pipeline: language ID, exact deduplication, near-duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import byte_bpe, decontaminate, exact_dedup, langid_ppm, simhash
from newsloom.llm.common import row_key, unused, without_rows
from newsloom.llm.queries import RANKS

#: A text that the best language needs more than this for, in bits a byte, is no language that was learned: a byte has 8.
MOST_BITS = 7.5

#: SQL has no prediction by partial matching; the stages are tested one by one instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows without a letter (null and empty texts too) and those that no learned language codes in MOST_BITS bits a byte.
    Languages are learned from all rows that name one; if none does, every row is rejected. Rows alike in id and text go or stay together."""
    row = unused(docs, "__row")
    found = langid_ppm.identify(docs.withColumn(row, row_key()), docs, id_col=row)
    return without_rows(docs, found.where((F.col("lang_pred") == "und") | (F.col("bits_per_byte") > MOST_BITS)).select(F.col("doc_id").alias("key")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: of most code points, then the smallest id, one without an id last. Null is empty."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near fingerprints: that of the smallest id, one without an id only where no other is. Texts without words are one component."""
    return simhash.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows with a window of a benchmark item, each by its own text, whatever its id; null and empty texts stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests for each row, repeated ones too; a null text has no tokens."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", leaks), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
