"""From raw documents to packed batches: each stage keeps, changes or places what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointengine.llm import line_crf, near_dedup, packing, quality_pu, suffix_dedup
from pointengine.llm.common import materialise


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    Each row is judged by its own text, a null one as empty, whatever its doc_id; all columns stay, and an empty table gives none.
    """
    return quality_pu.kept_documents(docs, _labels(spark, sf_dir))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field marks as content, and that pass the base rule.

    The field is fitted on the table as it was labelled: the stage before leaves hardly any boilerplate in docs.
    Null and empty texts fail the base rule.  Each row is judged by its own text and keeps all its columns.
    """
    return line_crf.kept_documents(docs, line_crf.fit(_documents(spark, sf_dir), _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: of the rows with the least doc_id one, nulls last, with all its columns.

    Null and empty texts are one group.
    """
    return near_dedup.kept_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that an earlier document holds, with all their columns.

    A text of which nothing but white space is left goes; a null doc_id counts as the largest.
    """
    return suffix_dedup.kept_documents(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a token-budget batch; a null or empty text has its end token alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", batches),
]

#: The learned and iterative stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's result is written and read again."""
    docs = _documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
