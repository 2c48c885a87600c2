"""From raw documents to token ids: filter, deduplicate, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsgrist.functions.lineage import cut_lineage
from newsgrist.llm.bpe import encode_documents
from newsgrist.llm.common import table
from newsgrist.llm.decontam import drop_leaking
from newsgrist.llm.exactdedup import drop_exact_duplicates
from newsgrist.llm.minhash import drop_near_duplicates
from newsgrist.llm.quality import keep_quality
from newsgrist.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on what comes in, does not reject."""
    return keep_quality(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the one with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies: the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is a benchmark item or nearly one."""
    return drop_leaking(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and digests of the documents that are left."""
    return encode_documents(spark, docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# A trained model, signatures and merges: not for SQL. tests/llm compares the stages with
# plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
