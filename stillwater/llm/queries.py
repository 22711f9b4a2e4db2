"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, licenses, lm_scoring, minhash, packing, quality, records, suffix_dedup, toxicity

#: Folder of the public tokenizers' files.
TOKENIZERS = None


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.language_model_scores(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal at 400 bytes, and bytes in passages of 200 that also start elsewhere."""
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup.with_passages(suffix_dedup.remove_repeats(docs), docs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_decontaminate, op3_minhash, op4_licenses, op5_suffix_dedup, op6_language_id,
        op7_token_records, op8_quality, op9_packing, op10_toxicity,
    )
}

#: The others draw on models, tokenizers, files or every 400-byte string of a table, which SQL cannot express or not in time; tests hold them against brute force.
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_minhash": minhash.ORACLE_SQL,
    "op8_quality": quality.ORACLE_SQL,
}
