"""One LAS file out of many tasks, and points added to a file that exists.

Every task packs its points into pieces, which are written to the shared folder; sums over the pieces before each give its place in the file, and tasks
then write the pieces at their places, all at once.  A task that is run again writes the same bytes to the same place.  Positional writes need a store
that offers them: a file system that the machines share (scheme ``file``).  Others take a folder of files, by las.write().
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dims
from ..errors import IncompatibleData
from ..operators import stats
from ..operators.cloud import PointCloud
from . import las, lasfile, scratch

#: Bytes of a piece, about.
PIECE_BYTES = 8 << 20
_PIECES = "part int, seq int, n long, lo array<long>, hi array<long>, returns array<long>, gps array<double>, content binary"


def local(spark: SparkSession, path: str) -> str:
    """The path on the file system that the machines share."""
    full = las._whole(spark, path)
    if not full.startswith("file:"):
        raise IncompatibleData(f"{path}: one file needs a store with positional writes; las.write() makes a folder of files")
    return las._store(full)[1]


def like(cloud: PointCloud, other: PointCloud) -> PointCloud:
    """The cloud with the other's scales and offsets."""
    if cloud.fmt != other.fmt:
        raise IncompatibleData(f"point formats {other.fmt} and {cloud.fmt}")
    return cloud if (cloud.scales, cloud.offsets) == (other.scales, other.offsets) else cloud.rescaled(tuple(other.scales), tuple(other.offsets))


def pieces(df: DataFrame, head: dict) -> DataFrame:
    """Packed points in pieces, with their statistics, written to the shared folder: what is placed afterwards stands fast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, h, held = TaskContext.get().partitionId(), 0, lasfile.Header(**head), []
        most = max(1, PIECE_BYTES // h.dtype.itemsize)

        def out(pts: np.ndarray) -> pa.RecordBatch:
            s = lasfile.statistics(pts, h)
            cols = [[part], [seq], [s["n"]], [s["lo"]], [s["hi"]], [s["returns"]], [s["gps"]], [pts.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

        for b in batches:
            held.append(lasfile.records_of(las.arrays_of(b), h, len(b)))
            while sum(map(len, held)) >= most:
                own = np.concatenate(held)
                yield out(own[:most])
                held, seq = [own[most:]], seq + 1
        if sum(map(len, held)):
            yield out(np.concatenate(held))

    path = scratch.folder(df.sparkSession, "pieces")
    df.mapInArrow(run, _PIECES).write.parquet(path)
    return df.sparkSession.read.schema(_PIECES).parquet(path)


_ARROW = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.float64()), pa.binary()]


def placed(made: DataFrame, size: Column | str) -> DataFrame:
    """The pieces with ``at``: the sum of ``size`` over all pieces before, in order of part and piece.

    Sums are taken within a part, and over one row a part, of which there are as many as tasks wrote.  No content is sorted or shuffled for them: a row
    a piece of about PIECE_BYTES is sent to all tasks.
    """
    size = F.col(size) if isinstance(size, str) else size
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of = made.select("part", "seq", size.alias("_size"))
    parts = of.groupBy("part").agg(F.sum("_size").alias("_all")).select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    own = of.withColumn("_own", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    at = own.join(parts, "part").select("part", "seq", (F.col("_base") + F.col("_own")).cast("long").alias("at"))
    return made.join(F.broadcast(at), ["part", "seq"])


def put(rows: DataFrame, path: str) -> int:
    """Writes (at, content) at their places in a file that exists; gives the bytes written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        with open(path, "r+b") as f:
            for b in batches:
                for at, raw in zip(b.column("at").to_pylist(), b.column("content"), strict=True):
                    f.seek(at)
                    total += f.write(raw.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["bytes"])

    return rows.select("at", "content").mapInArrow(run, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def statistics_of(made: DataFrame) -> dict:
    """The pieces' statistics as one, by one aggregation."""
    three = lambda f, c: [f(F.col(c)[k]).alias(f"{c}{k}") for k in range(3)]
    r = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *three(F.min, "lo"), *three(F.max, "hi"), *[F.sum(F.col("returns")[k]).alias(f"r{k}") for k in range(15)], F.min(F.col("gps")[0]).alias("g0"), F.max(F.col("gps")[1]).alias("g1")).first()
    full = bool(r["n"])
    return {"n": r["n"], "lo": [r[f"lo{k}"] for k in range(3)] if full else None, "hi": [r[f"hi{k}"] for k in range(3)] if full else None, "returns": [r[f"r{k}"] or 0 for k in range(15)], "gps": (r["g0"], r["g1"]) if full and r["g0"] is not None else None}


def write_file(cloud: PointCloud, path: str, records: list[lasfile.Record] | None = None, beside: tuple[tuple[str, str], ...] = ()) -> None:
    """One LAS file with all points, in the order of the table's partitions; it gets its name when it is complete.

    beside: (name so far, name) of complete files that belong to it and get their names just before.
    """
    target = local(cloud.df.sparkSession, path)
    head = las.head_of(cloud, records)
    made = pieces(cloud.df, head)
    h = lasfile.with_statistics(lasfile.Header(**head), [statistics_of(made)])
    h.extra = stats.extra_extremes(cloud)
    front, size = h.pack(), h.dtype.itemsize
    tmp = f"{target}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        with open(tmp, "wb") as f:
            f.write(front)
            f.seek(len(front) + h.count * size)
            f.write(h.tail())
            f.truncate()
        done = put(placed(made, "n").withColumn("at", F.col("at") * size + len(front)), tmp)
        if done != h.count * size:
            raise IncompatibleData(f"{done} bytes of points written, {h.count * size} expected")
        for a, b in (*beside, (tmp, target)):
            os.replace(a, b)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def append_file(cloud: PointCloud, path: str) -> None:
    """Points behind those of a file that exists; its records stay, extended ones move behind the new points, and its statistics grow.

    Coordinates follow the file's scales.  The file can be read at every moment: extended records are copied to their new place first and
    pointed at from there, then the points are written where nothing is read, and the counts come last.
    """
    spark = cloud.df.sparkSession
    target = local(spark, path)
    with pa.OSFile(target, "rb") as f:
        front, late = las._beginning(f, True)
    old = lasfile.Header.read(front, late)
    if old.compressed:
        raise IncompatibleData("points cannot be added to a compressed file")
    if cloud.fmt != old.fmt or tuple(e.name for e in cloud.extra) != tuple(e.name for e in old.extra):
        raise IncompatibleData(f"point format {old.fmt} with {[e.name for e in old.extra]}, not {cloud.fmt} with {[e.name for e in cloud.extra]}")
    cloud = like(cloud, PointCloud(cloud.df, old.fmt, tuple(old.scales), tuple(old.offsets)))
    size, base = old.dtype.itemsize, old.offset + old.count * old.record_size
    made = pieces(cloud.df, las.head_of(replace(cloud, extra=old.extra, version=old.version, records=())))
    own = statistics_of(made)
    if not own["n"]:
        return
    if size != old.record_size or os.path.getsize(target) < base:
        raise IncompatibleData("the file is cut short, or its records hold more than its header names")
    head = front[: dims.HEADER_SIZES[old.version]]
    if old.evlr_count:
        start = max(base + own["n"] * size, os.path.getsize(target))  # behind the new points, and behind itself
        with open(target, "r+b") as f:
            f.seek(start)
            f.write(late)
            os.fsync(f.fileno())
            old.evlr_start = start
            f.seek(0)
            f.write(old.patched(head))
            os.fsync(f.fileno())
    put(placed(made, "n").withColumn("at", F.col("at") * size + base), target)
    new = lasfile.with_statistics(replace(old), [own])
    if old.count:
        new.mins = tuple(map(min, old.mins, new.mins))
        new.maxs = tuple(map(max, old.maxs, new.maxs))
        new.gps = (min(old.gps[0], new.gps[0]), max(old.gps[1], new.gps[1]))
    new.returns = tuple(a + b for a, b in zip(old.returns, new.returns, strict=True))
    new.count += old.count
    new.extra = lasfile.merged_extremes(old.extra, stats.extra_extremes(replace(cloud, extra=old.extra)), old.count)
    with open(target, "r+b") as f:
        f.write(new.patched(head))
        if old.extra and (place := front.find(lasfile.pack_extra_dims(old.extra))) >= 0:
            f.seek(place)
            f.write(lasfile.pack_extra_dims(new.extra))
        os.fsync(f.fileno())
