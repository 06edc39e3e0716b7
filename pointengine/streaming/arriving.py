"""LAS files that keep arriving in a folder, as a stream of points and of running header figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.cloud import PointCloud
from ..sources import las, lasfile

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New files as they come; Spark's checkpoint remembers which were read."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.las").option("maxFilesPerTrigger", per_trigger).load(path)


def points(spark: SparkSession, path: str, like: PointCloud, names: list[str] | None = None, per_trigger: int = 100, tasks: int = 0) -> DataFrame:
    """The points of files as they come, with the file's path and their index in it; like: a cloud of their point format and scales.

    Spark's checkpoint has the names of the files of every batch, each file in one of them; only names go through the stream, and tasks read
    ranges of the files.
    """
    head = lasfile.Header(like.fmt, like.version, tuple(like.scales), tuple(like.offsets), extra=like.extra)
    found = files(spark, path, per_trigger).select("path", "length")
    return las.points_of(found, head, names, None, tasks or spark.sparkContext.defaultParallelism)


def header_figures(points: DataFrame, out: str, checkpoint: str, cloud: PointCloud):
    """A streaming query that keeps the bounds and count of every batch; their merge is a plain aggregate.

    A batch has a folder of its own, which a second run of the same batch writes anew: no point counts twice.  A batch without points leaves
    nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        c = PointCloud(df, cloud.fmt, cloud.scales, cloud.offsets)
        n = df.agg(F.count(F.lit(1)).alias("n"))
        figures = stats.header_bounds(c).crossJoin(n).where("n > 0")  # two one-row tables
        figures.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str) -> DataFrame:
    """One row: the bounds and count of all batches so far."""
    t = spark.read.parquet(out).drop("batch")
    low, high = (F.min, F.max)
    return t.agg(*[(low if c.endswith("_min") else high)(c).alias(c) for c in t.columns if c[2:] in ("min", "max")], F.sum("n").alias("n"))
