"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and works on all that the one before kept.  ``run``
writes the result of each stage to the shared folder and reads it again as the next one's input, so a lost executor
costs a re-read.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import mixing, packing, rlz, simhash, toxicity
from larder.llm.common import documents, stored
from larder.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; the chain is trained on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, toxicity.train(docs, labels, "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints the one with the least id."""
    return simhash.representatives(docs, shingle=4, bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words in windows of 35 that also start elsewhere; ``n_chars`` follows the new text."""
    return rlz.without_repeats(docs, window=35)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, as whole documents."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.packed(docs, vocabulary(), size=2048, end=0)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("rlz_substring_dedup", cut_repeats),
          ("hypergeometric_mixing", mix_sources), ("residual_packing", pack)]

#: SQL cannot express the classifier and the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
