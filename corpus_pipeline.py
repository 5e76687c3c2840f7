"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents.  The mixing stage returns its rows in the mixture's order, and
packing, which follows the files' names and the rows' places in them, fills its sequences in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from situ.llm.common import shared_folder
from situ.llm.exact import exact_deduplicate
from situ.llm.mixing import mix
from situ.llm.packing import pack
from situ.llm.quality import keep_good, train
from situ.llm.queries import WEIGHTS
from situ.llm.simhash import similar_deduplicate


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier learns from the labelled ones among them."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_deduplicate(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of five-word shingles of 0.8 or more link."""
    return similar_deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mix(docs, WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return pack(docs, file_order=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near dedup", simhash_near_dedup),
    ("mix sources", mix_sources),
    ("packing", packing),
]

#: The classifier, the fingerprints' components and the tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{i}")
            out = spark.read.parquet(f"{folder}/{i}")
        docs = out
    return docs
