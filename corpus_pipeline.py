"""The training-data pipeline: documents through five stages, each written as Parquet and read by the next.

Every stage but the last keeps the columns of its input.  A stage works on all that
the stage before it kept, and learns what it learns from that input and the tables
of the folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import language, mixing, near_dedup, packing, quality
from barweave.llm.base import stored, table

#: Words the packing stage's Python workers remember: fewer than alone, as they hold what earlier stages left too.
REMEMBERED = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, and those of no likely language, go."""
    return language.in_a_language(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that most of the labelled documents like them call good."""
    return quality.good_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate says."""
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text", "source")
    return mixing.repeated(mixing.mix(whole), ["__doc.*"])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of documents with their ids and places."""
    return packing.pack(docs, public_tokenizers.path(packing.MODEL), remembered=REMEMBERED)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Signatures, trained models and packing are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
