"""Bounded samples of labelled rows for fitting; counts and decisions never use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold

#: Training folds: rows whose crc32(doc_id as text) mod FOLDS is not 0.
FOLDS = 5


def smallest(df: DataFrame, n: int) -> DataFrame:
    """The n rows whose hashed doc_id is smallest: a uniform sample that any partitioning repeats."""
    return df.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(n)


def labelled(labels: DataFrame, name: str, value: int, n: int) -> DataFrame:
    """At most n training-fold doc_ids with this label; of contradicting labels of one id the largest counts."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    return smallest(one.groupBy("doc_id").agg(F.max("y").alias("y")).where(F.col("y") == value), n)


def with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, y of a bounded set of ids (doc_id, y), which is broadcast; of rows that share a doc_id the least text counts."""
    d = documents(docs).join(F.broadcast(ids), "doc_id")
    return d.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
