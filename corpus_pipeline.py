"""A corpus pipeline of five stages over `documents`.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of
documents, but for the last, which returns the index of the token files. Empty tables pass through all stages; further columns are kept
up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, jaccard, mixing, token_files, toxicity
from granary.llm.common import scratch, table
from granary.llm.queries import vocabulary


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, rejects go. Null texts score as empty ones; all stay where the labels tell nothing."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group stays: sets of five-word shingles, similarity of 0.8 or more. Rows without an id and texts without words stay."""
    return jaccard.keep_one_per_component(docs, n=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a test item's five-word shingles go. Rows without an id and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards target shares of sources, shuffled. Null sources are one source; rows of one id come equally often."""
    return mixing.mix_sources(docs, alpha=0.5, added=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: doc_id, start, n_tokens, ids_crc32 as read back. Null texts hold their end alone; null ids come first."""
    return token_files.token_files(docs, vocabulary())


STAGES = [
    ("toxicity", not_toxic),
    ("jaccard", one_of_each_group),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: The stages have a trained model and a token file format, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
