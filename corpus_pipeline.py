"""Corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosswise.llm import catalog, jaccard, packing, quality_rules, rule_ensemble
from crosswise.sources.storage import cut_lineage


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the base rule and the compression bands."""
    return quality_rules.keep_good(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble scores at the threshold or above. It learns from the
    labelled rows of the whole documents table, so that both classes are met."""
    return rule_ensemble.keep_good(docs, catalog.table(spark, sf_dir, "documents"), catalog.table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each component of near copies (five-word
    shingles, similarity 0.8)."""
    return jaccard.keep_one(docs, n=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 tokens."""
    _, placed = packing.pack(docs, catalog.vocabulary())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", by_rules),
    ("quality classifier", by_classifier),
    ("n-gram Jaccard join", one_of_each_group),
    ("best-fit packing", packed),
]

#: Compression ratios, fitted rules, components and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
