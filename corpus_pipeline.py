"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, jaccard, linededup, packing, quality
from slotwise.llm.common import FILE_TEXTS, ship, stored, table


def in_tasks(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows left of ``docs``, in no more tasks than so many documents need."""
    return kept.coalesce(docs.count() // FILE_TEXTS + 1)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; rows without id stay."""
    ship(spark)
    return in_tasks(quality.keep_good(docs, table(spark, sf_dir, "labels")), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them repeat; n_chars follows the text."""
    ship(spark)
    cleaned = in_tasks(linededup.dedup_lines(docs).select(*docs.columns), docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    ship(spark)
    return in_tasks(jaccard.one_of_each(docs), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship(spark)
    return in_tasks(decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The trained classifier and the tokenizer have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
