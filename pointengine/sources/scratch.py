"""A folder that all machines of the cluster share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset, as in a local test, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """What is written meanwhile is shuffled to so many partitions at least, so that a task's share does not grow with the table."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, str(max(int(own), least)))
    try:
        yield
    finally:
        spark.conf.set(name, own)
