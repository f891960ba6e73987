"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe.llm import decontaminate, fill_middle, licenses, lm_score, mixing, quality, secrets, sharding, simhash, spelling, suffixes, token_files, winnowing
from rxframe.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op2_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.drop_repeats(_table(spark, sf, "documents"))


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf, "documents"), 8)


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    d = quality.assess(docs, quality.trusted_labels(_table(spark, sf, "labels")))
    q = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return d.select("doc_id", *[F.col(f"_quality.{c}").alias(c) for c in q])


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf, "documents"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf, "documents"), path, tokenizer_path())
    return token_files.token_table(spark, path)


def lm_training(id_col: str) -> Column:
    """All but the fifth of ids whose checksum leaves 1: those are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 != 1


def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(_table(spark, sf, "documents"), lm_training("doc_id"))


def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(_table(spark, sf, "documents"))


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """The tables name no files: source and language stand in for the directories."""
    docs = _table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return licenses.scan(docs)


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), F.col("item").alias("item_id"), "word", "similarity", "distance")


def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.digest_table(_table(spark, sf, "documents"))


def op12_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.edited_table(_table(spark, sf, "documents"))


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    runs = spelling.letter_runs(_table(spark, sf, "documents"))
    return spelling.group_variants(spelling.vocabulary(spelling.with_slips(runs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_array": op2_suffix_array,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_lm_score": op7_lm_score,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
    "op11_fill_middle": op11_fill_middle,
    "op12_fingerprints": op12_fingerprints,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op5_mixing": mixing.MIX_SQL, "op11_fill_middle": fill_middle.FILL_SQL}
