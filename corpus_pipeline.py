"""A cleaning pipeline for the documents of a training corpus, of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all
but the last return the columns of documents. What the stages do with nulls, empty and long
texts, ties and repeated rows stands in the operators' own docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, pieces, quality, suffix_dedup, templates
from tessera.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first document stays."""
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus go, and documents of nothing else."""
    return suffix_dedup.remove(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark questions go, re-parameterised ones included."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces_sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece identifiers."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("pieces_sampled", pieces_sampled),
]

#: Learned word lists, component search and sampling have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
