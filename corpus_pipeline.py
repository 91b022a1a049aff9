"""The corpus pipeline: documents to packed sequences. Part of symgraph.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents. An empty table passes through as such; without labels the
classifier scores 0.5 and rejects everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import mixing, near_duplicates, packing, quality_classifier, secrets
from symgraph.llm.common import crc_fold, documents, labels, staged
from symgraph.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good. Labels of the fold held out by op10 stay unused here too."""
    model = quality_classifier.train(docs, labels(spark, sf_dir), allowed=crc_fold("doc_id", 4) != 2)
    return quality_classifier.accepted(docs, model)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return near_duplicates.one_of_each(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicate), ("secret scan", secret), ("mixing", mix), ("packing", pack)]

#: The classifier, sketches and tokens have no SQL; tests/llm compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
