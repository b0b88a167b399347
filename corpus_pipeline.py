"""Corpus pipeline: documents -> without toxic ones -> without exact copies -> one of
each group of near copies -> without benchmark items -> mixed to target weights.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept; all but the last return the columns they were given.  Rows with nulls,
empty texts or repeated ids pass through as the operators define.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsight.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from flowsight.llm.common import materialise, table
from flowsight.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7; labels with crc32 mod 3 = 1 are not learnt from."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return toxicity.keep_clean(docs, field, threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the row with the largest id."""
    return exact_dedup.keep_latest(docs, held_out(2, 1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within 2 bits the one with the smallest id."""
    return simhash.keep_one(docs, shingle_words=3, max_bits=2)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document kept so far: how many of its words the mix takes."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies),
          ("decontaminate", drop_benchmark), ("mixing", mix_sources)]
#: Trained scores and hash fingerprints are not SQL; tests check run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
