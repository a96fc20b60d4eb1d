"""A corpus pipeline of five stages; each works on all rows the one before it kept.

``run`` applies them to the documents table. Every stage's rows are written as Parquet to the shared
folder and read again as the next one's documents. A trained classifier, a fingerprint and a tokenizer
can't be put in SQL, so ORACLE_SQL is None and the tests hold the rows against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm import byte_bpe, exact_dedup, mixing, quality, simhash
from leafspark.llm.common import staged, table

#: The mixture's part of what the stages before it kept.
SHARE = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below one half."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents that are equal but for white space."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of documents whose SimHashes link at three bits or fewer."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's part of the mixture."""
    return mixing.mix_documents(docs, mixing.WEIGHTS, share=SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and how many bytes they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.octet_length(byte_bpe.decoded(F.col("tokens"), path)).cast("long").alias("n_bytes"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
