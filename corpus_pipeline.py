"""From documents to token ids: language ID, SimHash near-dedup, decontamination, source mixing, binary output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from orolith.llm import decontam, langid, mixing, shingles, simhash, tokenbin
from orolith.llm.common import scratch_path, table
from pyspark.sql import DataFrame, SparkSession

#: SQL has no n-gram model and no tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go."""
    return langid.accepted(docs, langid.train(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, similarity of 0.8 or more. Candidates come from SimHash,
    those that its radius does not reach from MinHash bands; exact shingle sets decide."""
    return simhash.first_of_each(docs, shingles.near_copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the sources' target weights say."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written as token ids; the result is read from the files."""
    return tokenbin.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
