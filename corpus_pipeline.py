"""A training-corpus pipeline: each stage takes all documents its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heddle.llm import bpe, mixing, ngram_join, quality, toxicity
from heddle.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null, empty and short texts go; all columns stay as they are."""
    return quality.kept(docs)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5. The grammar learns from the labelled ones among them; the verdict is by text alone.

    Null and empty texts match nothing and stay; all columns stay as they are. An empty table, or one without labels, is judged by
    the known insults.
    """
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), holding_out=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % or more of its five-word shingles. Wordless texts, and rows without doc_id, stay."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources reads them, in the order in which it does; wordless ones go."""
    return mixing.apply_mix(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", byte_pairs),
]

#: The learned stage and the merges can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
