"""Training-data pipeline over documents: filter, deduplicate, pack.

Each stage calls one operator of churnforge.llm on all that its predecessor
kept; every stage's result is written as Parquet in the shared checkpoint
folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions.exprs import unique_names
from churnforge.llm.common import load, materialise
from churnforge.llm.exact_dedup import exact_filter
from churnforge.llm.language_id import language_filter
from churnforge.llm.quality_rules import quality_filter
from churnforge.llm.queries import packed_documents
from churnforge.llm.simhash_dedup import near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts that are null or have no letter
    (``und``) go."""
    return language_filter(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by the removal
    of lines that many documents of their host share."""
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near copies. Documents
    without an id stay unless their group has one with an id.

    What comes back to the texts is the table of ids that go, so the texts are
    shuffled only where the planner finds that table too large to send around.
    """
    found = near_duplicates(docs, shingle=4, max_bits=4)
    gone_id = unique_names(["_gone_id"], docs.columns)[0]
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = materialise(found.groupBy(F.col("doc_id").alias(gone_id)).agg(F.max(stays).alias("stays"))
                       .filter(~F.col("stays")).select(gone_id), "near-gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, packed into sequences."""
    return packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", packing),
]

#: Tokenising, fingerprints and context trees have no SQL form; tests/llm holds
#: the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
