"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and reread as the next stage's ``docs``.
All but the last return the columns of documents.  The last writes the token files
of what is left and returns one row per document read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxframe.llm import decontaminate, mixing, quality, simhash, token_files
from rxframe.llm.queries import tokenizer_path
from rxframe.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.trusted_labels(labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target: a document comes once per epoch that takes it."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; per document: id, start, number and checksum of its ids."""
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_tokens(docs, path, tokenizer_path())
    return token_files.token_table(spark, path)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("source_mix", source_mix), ("token_output", token_output)]

# fingerprints and token ids are outside SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
