"""Helpers that several operators share: input normalisation, folds, row numbers, shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Sub-ranges in which rows of one key are numbered; keys x this many offsets is all that is broadcast.
NUMBER_RANGES = 2048
#: A key that holds more than one row in this many is hot.
HOT_KEYS = 4096


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def documents(df: DataFrame, *extra: str | Column) -> DataFrame:
    """doc_id and text alone (and extra): a table's other columns cannot clash with an operator's own."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def where_text(docs: DataFrame, accepts: Callable[[pa.RecordBatch], Iterator[list[bool]]]) -> DataFrame:
    """The rows, with all their columns, whose own text is accepted; a null text is an empty one.

    accepts gives the verdicts of a batch (text) in order, in pieces.  No id is used, so rows that share one or have
    none are judged one by one.  A string column is read within its row, so no text is sent to Python twice.
    """
    inside = "text" in docs.columns and docs.schema["text"].dataType == T.StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_row").field("text") if inside else batch.column("_text")
            texts = pa.RecordBatch.from_arrays([text], ["text"])
            keep = pa.array([bool(v) for part in accepts(texts) for v in part], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("_row").filter(keep)], ["_row"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, *([] if inside else [F.col("text").cast("string").alias("_text")]))
    return rows.mapInArrow(run, T.StructType([rows.schema["_row"]])).select("_row.*")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster's machines share.

    Only where that is unset, as in a local test, a folder under the warehouse is used and set as
    the session's checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext.getCheckpointDir()
        base = have.rsplit("/", 1)[0] if have else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoint"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, on storage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; a null text counts as an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 32))


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with table on key, where table has each key once and n says how many rows hold it.

    Keys that hold more than one row in HOT_KEYS are fewer than HOT_KEYS, so they are broadcast and their rows stay where
    they are; the others are joined by a shuffle, in which no key is hot.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(n) > total // HOT_KEYS + 1))
    rest = table.where(F.col(n) <= total // HOT_KEYS + 1)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function, at whose end its Python worker, which waits for the next task, gives free memory back to the machine."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return task


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups from a partition that is sorted by key: about ``rows`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        lo = 0
        for at in heads[1:]:
            if at - lo >= rows or at == heads[-1]:
                yield from t.slice(lo, at - lo).to_batches()
                lo = int(at)
        held, size = [b for b in t.slice(lo).combine_chunks().to_batches()], len(t) - lo
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def numbered(df: DataFrame, key: str, tie: list[Column], out: str, n_keys: int, sub: Column | None = None) -> DataFrame:
    """Add a gapless number from 0 within each key, without sorting a whole key in one task.

    Rows of a key fall into NUMBER_RANGES sub-ranges by a hash of the tie columns; counts of (key, sub-range)
    give each sub-range its first number, and only its own rows are sorted.  n_keys bounds the keys,
    so at most n_keys * NUMBER_RANGES offsets are broadcast.  Rows alike in all tie columns are interchangeable.
    Where sub gives other sub-ranges (at most twice as many), ascending with the tie columns, numbers follow these alone.
    """
    df = df.withColumn("_sub", F.pmod(F.xxhash64(*tie), F.lit(NUMBER_RANGES)).cast("int") if sub is None else sub)
    count = df.groupBy(key, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select(key, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if n_keys * NUMBER_RANGES <= 1 << 20:
        first = F.broadcast(first)
    row = F.row_number().over(Window.partitionBy(key, "_sub").orderBy(*tie)) - 1
    return df.join(first, [key, "_sub"]).withColumn(out, (F.col("_first") + row).cast("long")).drop("_sub", "_first")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
