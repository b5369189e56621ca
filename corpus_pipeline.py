"""A corpus pipeline of five stages: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import mixing, packing, quality, simhash, suffix_dedup
from headway.llm.common import new_path
from headway.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Null, empty and very short texts go; repeated rows are judged alike; an empty table stays empty."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: SimHash fingerprints find them, a similarity of 0.8 or more of their
    sets of five-word shingles decides. Texts without words are one group, of repeated rows one stays."""
    return simhash.keep_first(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars counts what is left. All rows stay; null texts become empty. Rows with
    equal ids, and null ids, don't remove from each other; an empty table stays empty."""
    return suffix_dedup.dedup_documents(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for. Texts without words are never taken, a null source is a source; rows that share id and source are taken
    equally often; an empty table stays empty."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. A null text is empty and has the end id only; repeated rows are packed each; an empty table
    gives no pieces."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("source mixing", mix_sources), ("packing", pack_sequences)]

#: Shingle hashes, random rounding and the tokenizer aren't expressible in SQL; the operators of the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
