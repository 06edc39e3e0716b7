"""Numbering of a whole table in the order of a whole-number column, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch


def running(df: DataFrame, by: str, what: str, out: str) -> DataFrame:
    """The sum of ``what`` over all rows up to this one, in order of ``by``, whose values are distinct.

    Spark deals the rows to ranges of about equal size, however the values lie, and they are written so: what a range holds stands fast
    then.  Ranges get their own sums first; what stands before a range, of which there are as many as shuffle partitions, is added to the sum within it.
    """
    spark = df.sparkSession
    path = scratch.folder(spark, "ranges")
    df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = dealt.groupBy("_range").agg(F.sum(what).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_own", F.sum(what).over(within)).join(F.broadcast(sums), "_range").withColumn(out, (F.col("_base") + F.col("_own")).cast("long")).drop("_range", "_own", "_base")


def ranked(df: DataFrame, by: str, out: str) -> DataFrame:
    """The row's number from 0 in order of ``by``, whose values are distinct."""
    return running(df.withColumn("_one", F.lit(1)), by, "_one", out).withColumn(out, F.col(out) - 1).drop("_one")
