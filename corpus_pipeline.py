"""The corpus pipeline: good documents, one of each near copy, none with test items, mixed by source, as token shards.

Each stage takes any columns beside those of documents, whatever their names, and an empty table, which stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, decontaminate, mixing, quality, simhash, tokens

#: A round trip through files and a tokenizer is beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every quality rule lets through; null and empty texts go, repeats are judged alike."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows without an id stay."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, null sources as a source of their own; the files that are written follow it."""
    return mixing.in_mixed_order(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str, *, by_files: bool = True) -> DataFrame:
    """What the token shards hold for each document, empty and repeated ones too.

    Shards follow the files' order, by name and row, so that the mixture stays; docs must then be read from
    files, else AnalysisException. Without by_files they follow the ids.
    """
    if not by_files:
        return tokens.token_shards(docs, tokens.default_tokenizer())
    name = F.col("_metadata.file_name")
    rows = docs.select("doc_id", "text", F.length(name).alias("_length"), name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return tokens.token_shards(rows, tokens.default_tokenizer(), order=[F.col("_length"), F.col("_file"), F.col("_row")])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents below sf_dir; each one's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
