"""A corpus pipeline of five stages over documents: toxicity, exact dedup, n-gram join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return the columns
of documents. The last returns the mix: a row for each time that a document is taken, whole or in part. A stage's result has to be written before the next
stage is called, which clears the scratch folders of those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanespan.llm.common import stash, sweep
from lanespan.llm.decontam import drop_contaminated
from lanespan.llm.exact_dedup import drop_copies
from lanespan.llm.mixing import sampled
from lanespan.llm.ngram_join import drop_near_copies
from lanespan.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    sweep(spark, docs)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the longest, then that of the smallest id."""
    sweep(spark, docs)
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 of their five-word shingles connect, that of the smallest id."""
    sweep(spark, docs)
    return drop_near_copies(docs, 5, 80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    sweep(spark, docs)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, copy, n_words and text of all that is taken; documents of which nothing is taken go."""
    sweep(spark, docs)
    return sampled(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
