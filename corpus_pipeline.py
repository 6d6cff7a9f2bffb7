"""From raw documents to packed sequences: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is
written as Parquet and read again for the next. All but the last return the columns of ``documents``.
Stages handle what their operators handle: nulls in any column, empty tables, repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkline.llm import decontaminate, jaccard, packing, pii, toxicity
from inkline.llm.common import written
from inkline.llm.queries import table, tokenizer_files


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word Jaccard similarity of 0.8 or more): the one with the least id."""
    return jaccard.one_of_each(docs, shingle=5, threshold=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut from their texts."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars", window=10)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts."""
    return pii.redact(docs, pii.fit_selector(docs), length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, **tokenizer_files(), length=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL cannot express the trained stages; tests/llm compares them with plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
