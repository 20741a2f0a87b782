"""From raw documents to packed training sequences, stage by stage.

Every stage takes any rows: null ids, texts and sources, empty and very long
texts, repeated rows and extra columns. Each says what becomes of them. An empty
table passes through all stages as an empty one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, packing, quality, simhash, substring
from graphloom.llm.common import shared_folder
from graphloom.llm.queries import tokenizer_path

#: SQL cannot express fingerprints, splitting trees and packing: the tests hold the stages against plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the rows that the current policy rejects; null and empty texts are among those. Rows are judged one by one, whatever ids they share."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id, rows without one last. Null and empty texts are one group."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier row has, by doc_id and text, or that stand earlier in the same text. Rows left without a word go."""
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of the mix: a row for each document's part of a dealt block, in shards. Null sources are one source; rows without a word, and those that the mix leaves out, go."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again by the next."""
    out = os.path.join(shared_folder(spark, "pipeline"), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}_{name}")
        docs = spark.read.parquet(f"{out}/{k}_{name}")
    return docs
