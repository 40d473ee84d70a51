"""Documents to token ids: quality, exact and near duplicates, mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deltasieve.llm import bpe, exact_dedup, mixing, near_copies, quality
from deltasieve.llm._common import stash

#: Documents less likely than this to be good are rejected: low, so that doubtful ones stay.
THRESHOLD = 0.3


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier doesn't reject; null texts, sources and languages are scored like others.

    Repeated rows are kept or go alike. Without labels of both kinds, or without documents, all of them are kept.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: that of the smallest doc_id, null last; of rows alike one. Null counts as empty."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, null last; texts without words are one group."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as the mixture draws it; texts without words are never drawn, null is a source."""
    return mixing.materialise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of each row; a null text is empty, repeated rows give repeated rows."""
    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stash(docs, f"stage-{at}")
    return docs


#: The classifier and the mixture's draws have no SQL form; tests compare each stage with plain Python.
ORACLE_SQL = None
