"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.

Defined cases, in every stage: a null or empty text has no words, so the first stage rejects it, the second takes all such as
copies of each other, the third finds nothing in it, the fourth gives it no words and leaves it out unless whole epochs
are due, and the fifth counts its overhead; rows of no or equal doc_id are judged by their own texts; repeated rows stay in the
second stage; very long texts are worked on whole; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, mixing, quality, sharding, similarity
from palimpsest.llm.common import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from their language reject go."""
    return quality.judge(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id stays."""
    return similarity.drop_near_duplicates(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.decontaminate(docs.select(*COLUMNS), benchmark)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for; the one at a source's cut has its first words only."""
    mixed = mixing.materialise(mixing.mix(docs.select(*COLUMNS)))
    return mixed.select(*[c for c in COLUMNS if c != "n_chars"], F.length("text").cast("long").alias("n_chars"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard, and its place in the shard."""
    return sharding.shard(docs.select(*COLUMNS), "doc_id", "text", shards=24)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Word histograms against references, fingerprints, components and template windows can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
