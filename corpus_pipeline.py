"""From raw documents to training sequences: five stages, each written as a table and read again by the next.

Every stage but the last returns the columns of ``documents`` for the rows it
keeps. What the stages look up besides (labels, the benchmark) lies in
``sf_dir``. Every row is judged for itself, also where rows share an id or have
none; of near duplicates such rows come after all rows with an id of their own.
Null texts are empty; extra columns stay as they are; empty tables stay empty.
The last table holds the ids to train on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageprism.llm import quality
from pageprism.llm.common import by_rows, materialize, table
from pageprism.llm.decontaminate import contaminated_words
from pageprism.llm.exact_dup import DigestIndex, deduplicate_rows
from pageprism.llm.near_dup import near_duplicates
from pageprism.llm.packing import packed_documents
from pageprism.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    return by_rows(docs, lambda rows: quality.classify(rows, labels, model=model).filter("kept"), "source", "lang")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return deduplicate_rows(docs, DigestIndex(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over five-word shingles with a similarity of at least 0.8."""
    return by_rows(docs, lambda rows: near_duplicates(rows, k=5, num=80, den=100).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return by_rows(docs, lambda rows: contaminated_words(rows, items, window=10, shingle=5).filter(F.size("spans") == 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, their sequence of at most 4096 tokens and their place in it."""
    return packed_documents(docs, tokenizer(), end_id=1, capacity=4096, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Regression, components and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
