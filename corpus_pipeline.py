"""From raw documents to token files: five stages, each written as Parquet and read again.

1. language identification drops documents without a known language,
2. near-deduplication keeps one document of each class,
3. decontamination drops documents with benchmark passages,
4. mixing puts the documents left in the order of the target weights,
5. token output writes their ids in that order and returns place, length and checksum of each.

The first four return the columns of `documents`. The mix is the order of rows across and inside the
files of its stage, which the last stage takes from the file names and row numbers that Spark gives.
The stages let the session send texts to Python in batches of 4 MB (`small_batches`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bagminhash, decontaminate, language, mixing, tokens
from panelforge.llm.graph import small_batches
from panelforge.llm.queries import SHARES, table, vocabulary
from panelforge.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.drop_unknown(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bagminhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, SHARES)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch_path(spark, "corpus-tokens")
    placed = docs.select(
        "doc_id",
        "text",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    tokens.write_tokens(placed, path, vocabulary(), order_by=("file", "row"))
    files = spark.read.parquet(path)
    return tokens.with_starts(tokens.checksums(files), files).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_output", token_output),
]

# Learned models, signatures and tokenizers have no SQL form; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
