"""Registered queries of the text operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import extraction, imatch, licences, merkle, mixing, neighbours, packing, resampling, rlz, sharding, simhash, toxicity, whitening
from larder.llm.common import documents


def op1_hypergeometric_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.summary(documents(spark, sf), weights=(5, 2, 1), share=1.5, most=2.0)


def op2_subsequence_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return extraction.extracted(pages, extraction.train(pages))


def vocabulary() -> tuple[str, str, str]:
    """The tokenizer file, the same vocabulary as ranks, and its pattern; they come with the package of public tokenizers on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_residual_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(documents(spark, sf), vocabulary(), size=2048, end=0)


def op4_gumbel_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality")


def op5_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op6_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf), shingle=4, bits=4)


def op7_chain_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels, "toxic")
    return toxicity.score(docs.select("doc_id", "text"), chain).drop("text")


def op9_rlz_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return rlz.digest(documents(spark, sf), window=35).drop("factors")


def op8_imatch_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf))


def op10_sentence_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scanned(documents(spark, sf))


def op11_veb_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.digests(documents(spark, sf))


def op12_bit_sliced_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.components(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_kd_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf), shards=40)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline  # it uses this module

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "pipeline": pipeline,
    "op1_hypergeometric_mixing": op1_hypergeometric_mixing,
    "op2_subsequence_extraction": op2_subsequence_extraction,
    "op3_residual_packing": op3_residual_packing,
    "op4_gumbel_resampling": op4_gumbel_resampling,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_chain_toxicity": op7_chain_toxicity,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_rlz_substring_dedup": op9_rlz_substring_dedup,
    "op10_sentence_licences": op10_sentence_licences,
    "op11_veb_manifest": op11_veb_manifest,
    "op12_bit_sliced_whitening": op12_bit_sliced_whitening,
    "op13_kd_sharding": op13_kd_sharding,
}

SQL: dict[str, str] = {
    "op10_sentence_licences": licences.sql(),
    "op11_veb_manifest": merkle.sql(),
}
