"""Octree files: one LAS file whose points stand node after node, with an index of pages, and queries that read only what a box needs.

The layout is that of the public octree profile of the format (info record first, pages of 32-byte entries, a page of its own where an entry's
point count is -1), with plain records in place of compressed ones.  A page holds PAGE_LEVELS levels below its root, so it is small
whatever the tree's size.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..errors import IncompatibleData
from ..operators import spatial
from ..operators.cloud import AXES, PointCloud
from ..operators.ranks import running
from . import las, lasfile, onefile, scratch

#: Levels of a page.
PAGE_LEVELS = 3
#: Bytes that one task reads with one seek, about, and gaps between byte ranges that are read over.
READ_BYTES = 16 << 20
#: Points that a task joins or sorts, about, while a file is written.
TASK_ROWS = 1 << 19
_KEY = ("level", "vx", "vy", "vz")
_ENTRIES = "level int, vx int, vy int, vz int, offset long, byte_size int, point_count int"
_ENTRY = np.dtype([("level", "<i4"), ("vx", "<i4"), ("vy", "<i4"), ("vz", "<i4"), ("offset", "<u8"), ("byte_size", "<i4"), ("point_count", "<i4")])


# ------------------------------------------------------------------------------------------------------ writing


def write(cloud: PointCloud, path: str, depth: int, cells: int = 32, priority: str | None = None, page_levels: int = PAGE_LEVELS) -> None:
    """The cloud as an octree file: levels by sampling, nodes in order of their keys, pages behind the points.

    The root is the cube around all points.  priority: a column whose smaller values come to coarser levels, a hash of the coordinates by default.
    """
    spark = cloud.df.sparkSession
    if cloud.fmt < 6:
        raise IncompatibleData("octree files have point formats 6 to 8")
    target = onefile.local(spark, path)
    lo, hi, count = cloud.df.agg(F.array(*[F.min(a) for a in AXES]), F.array(*[F.max(a) for a in AXES]), F.count(F.lit(1))).first()
    lo = [0, 0, 0] if lo[0] is None else lo
    hi = lo if hi[0] is None else hi
    low = [min(a * s, b * s) + o for a, b, s, o in zip(lo, hi, cloud.scales, cloud.offsets, strict=True)]
    side = max(max((b - a) * abs(s) for a, b, s in zip(lo, hi, cloud.scales, strict=True)), min(map(abs, cloud.scales))) * (1 + 2.0**-20)
    # from the root's corner, in whole numbers first: the point at the corner is at 0 and not just below
    own = {a: (F.col(a).cast("long") - F.lit(x if s > 0 else y)) * F.lit(s) for a, s, x, y in zip(AXES, cloud.scales, lo, hi, strict=True)}
    order = F.col(priority) if priority else F.xxhash64(*AXES)
    levelled = spatial.sampled_levels(cloud.df.withColumns({f"_{a}": v for a, v in own.items()}), [F.col(f"_{a}") for a in AXES], side, depth, cells, order)
    keyed = levelled.select("*", *spatial.voxel(F.col("level"), *[F.col(f"_{a}") for a in AXES], side))
    keyed = keyed.withColumn("_order", order).drop(*[f"_{a}" for a in AXES])
    where = scratch.folder(spark, "octree")
    with scratch.partitions(spark, math.ceil(count / TASK_ROWS)):
        keyed.write.parquet(where)
    keyed = spark.read.parquet(where)
    nodes = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("point_count"))
    gps = keyed.agg(F.min("gps_time"), F.max("gps_time")).first()

    head = las.head_of(cloud, [r for r in cloud.records if r.user_id != "copc"])
    head["version"] = "1.4"
    # a key may have many points: the order's value splits them between tasks
    dealt = keyed.repartitionByRange(*_KEY, "_order").sortWithinPartitions(*_KEY, "_order").drop(*_KEY, "_order")
    with scratch.partitions(spark, math.ceil(count / TASK_ROWS)):
        made = onefile.pieces(dealt, head)
    h = lasfile.with_statistics(lasfile.Header(**head), [onefile.statistics_of(made)])
    info = lambda root, size: lasfile.pack_copc_info(tuple(a + side / 2 for a in low), side / 2, side / cells, root, size, (gps[0] or 0.0, gps[1] or 0.0))
    h.records = [info(0, 0), *[r for r in h.records if not r.extended]]
    front, size = len(h.pack()), h.dtype.itemsize
    behind = front + h.count * size
    body = behind + lasfile.EVLR.size
    stored = spatial.with_layout(nodes, size).select(*_KEY, (F.col("offset") + front).alias("offset"), F.col("byte_size").cast("int"), F.col("point_count").cast("int"))
    pages, total, root = _pages(stored, body, page_levels)
    h.records[0] = info(body, root)
    late = [r for r in cloud.records if r.extended and r.user_id != "copc"]
    h.records += [lasfile.Record("copc", 1000, "EPT hierarchy", b"", True), *late]
    tmp = f"{target}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        with open(tmp, "wb") as f:
            f.write(h.pack())
            f.seek(behind)
            f.write(lasfile.EVLR.pack(0, lasfile.to_text("copc", 16), 1000, total, lasfile.to_text("EPT hierarchy", 32)))
            f.seek(body + total)
            f.write(b"".join(r.pack() for r in late))
            f.truncate()
        done = onefile.put(onefile.placed(made, "n").withColumn("at", F.col("at") * size + front), tmp) + onefile.put(pages, tmp)
        if done != h.count * size + total:
            raise IncompatibleData(f"{done} bytes written, {h.count * size + total} expected")
        os.replace(tmp, target)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def _pages(nodes: DataFrame, body: int, page_levels: int) -> tuple[DataFrame, int, int]:
    """(at, content) of all pages, their bytes in all, and those of the root's page.

    A page belongs to a node whose level is a multiple of page_levels, and lists the nodes down to the next such level, whose pages it points to.
    Ancestors that hold no points get entries of their own.
    """
    spark = nodes.sparkSession
    ways = nodes.select("level", "vx", "vy", "vz", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("up"))
    every = ways.select((F.col("level") - F.col("up")).alias("level"), *[F.expr(f"shiftright({v}, up)").alias(v) for v in _KEY[1:]]).distinct()
    root = spark.createDataFrame([(0, 0, 0, 0)], "level int, vx int, vy int, vz int")
    every = every.unionByName(root).distinct()
    full = every.join(nodes, list(_KEY), "left").select(*_KEY, F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("byte_size", F.lit(0)).alias("byte_size"), F.coalesce("point_count", F.lit(0)).alias("point_count"))
    up = f"(level % {page_levels})"
    owner = lambda shift: [F.expr(f"level - {shift}").alias("p_level"), *[F.expr(f"shiftright({v}, {shift})").alias(f"p_{v}") for v in _KEY[1:]]]
    inside = full.select(*owner(up), *_KEY, "offset", "byte_size", "point_count", F.lit(False).alias("page"))
    points_to = full.where(f"level > 0 and level % {page_levels} = 0").select(*owner(page_levels), *_KEY, F.lit(0).cast("long").alias("offset"), F.lit(0).alias("byte_size"), F.lit(-1).alias("point_count"), F.lit(True).alias("page"))
    path = scratch.folder(spark, "entries")
    inside.unionByName(points_to).write.parquet(path)
    entries = spark.read.parquet(path)
    p_key = [f"p_{k}" if k != "level" else "p_level" for k in _KEY]
    size = entries.groupBy(*p_key).agg(F.count(F.lit(1)).alias("point_count")).select(*[F.col(p).alias(k) for p, k in zip(p_key, _KEY, strict=True)], "point_count")
    at = spatial.with_layout(size, _ENTRY.itemsize).select(*_KEY, (F.col("offset") + body).alias("p_at"), F.col("byte_size").cast("int").alias("p_size"))
    where = scratch.folder(spark, "pages")
    at.write.parquet(where)
    at = spark.read.parquet(where)
    total = at.agg(F.sum("p_size")).first()[0]
    first = at.where("level = 0").first()
    if first.p_at != body:
        raise IncompatibleData("the root's page is not the first")
    linked = entries.join(at, list(_KEY), "left")
    linked = linked.select(*p_key, *_KEY, F.when(F.col("page"), F.col("p_at")).otherwise(F.col("offset")).alias("offset"), F.when(F.col("page"), F.col("p_size")).otherwise(F.col("byte_size")).alias("byte_size"), "point_count")
    grouped = linked.groupBy(*p_key).agg(F.sort_array(F.collect_list(F.struct(*_KEY, "offset", "byte_size", "point_count"))).alias("e"))  # bounded: a page's entries
    grouped = grouped.join(at.select(*[F.col(k).alias(p) for p, k in zip(p_key, _KEY, strict=True)], F.col("p_at").alias("at")), p_key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = []
            for e in b.column("e"):
                raw = np.zeros(len(e), _ENTRY)
                for name in _ENTRY.names:
                    raw[name] = e.values.field(name).to_numpy(zero_copy_only=False)
                content.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(content, pa.binary())], ["at", "content"])

    return grouped.select("at", "e").mapInArrow(pack, "at long, content binary"), total, first.p_size


# ------------------------------------------------------------------------------------------------------ reading


def info_of(h: lasfile.Header) -> dict:
    """The info record, which has to be the first."""
    own = [(r.user_id, r.record_id) for r in h.records]
    if ("copc", 1) not in own:
        raise IncompatibleData("no octree file: the info record is missing")
    if own[0] != ("copc", 1):
        raise IncompatibleData("no octree file: the info record is not the first")
    return lasfile.parsed(h.records[0])


def _front(spark: SparkSession, path: str) -> tuple[str, lasfile.Header, dict]:
    full = las._whole(spark, path)
    store, at = las._store(full)
    with store.open_input_file(at) as f:
        h = lasfile.Header.read(las._beginning(f, False)[0], b"")
    return full, h, info_of(h)


def _read_ranges(path: str):
    """Rows (offset, byte_size) to the bytes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = las._store(path)
        with store.open_input_file(at) as f:
            for b in batches:
                for lo, n in zip(b.column("offset").to_pylist(), b.column("byte_size").to_pylist(), strict=True):
                    f.seek(lo)
                    raw = np.frombuffer(f.read(n), _ENTRY)
                    if raw.nbytes < n:
                        raise IncompatibleData(f"{path} ends within a page at {lo}")
                    yield pa.RecordBatch.from_arrays([pa.array(raw[k].astype(np.int64) if k == "offset" else raw[k]) for k in _ENTRY.names], list(_ENTRY.names))

    return run


def _box(info: dict, lo, hi) -> tuple[list[float], list[float], float]:
    """The box from the root's corner."""
    corner = [c - info["halfsize"] for c in info["center"]]
    full = (tuple(lo) + (-math.inf,))[:3], (tuple(hi) + (math.inf,))[:3]  # a box of two axes holds every height
    room = 1e-9 * (info["halfsize"] + max(map(abs, info["center"])))  # for rounding
    return [a - c - room for a, c in zip(full[0], corner, strict=True)], [b - c + room for b, c in zip(full[1], corner, strict=True)], 2 * info["halfsize"]


def index(spark: SparkSession, path: str, box: tuple | None = None, stop: int | None = None) -> DataFrame:
    """(level, vx, vy, vz, offset, byte_size, point_count): nodes with points, read page by page.

    One job a depth of pages: the frontier's pages are dealt to tasks, entries outside the box or beyond level ``stop`` are left out, and pages
    that remaining entries point to are the next frontier.  A page that the box does not reach is never read.
    """
    full, _, info = _front(spark, path)
    frontier = spark.createDataFrame([(info["root_offset"], info["root_size"])], "offset long, byte_size int")
    want = F.lit(True) if stop is None else F.col("level") < stop
    if box:
        lo, hi, side = _box(info, *box)
        want = want & spatial.overlaps(side, lo, hi)
    found, out = True, None
    while found:
        where = scratch.folder(spark, "frontier")
        frontier.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_read_ranges(full), _ENTRIES).where(want).write.parquet(where)
        read = spark.read.schema(_ENTRIES).parquet(where)
        nodes = read.where("point_count >= 0")
        out = nodes if out is None else out.unionByName(nodes)
        frontier = read.where("point_count = -1").select("offset", "byte_size")
        found = not frontier.isEmpty()
    return out.where("point_count > 0")


def reads(nodes: DataFrame, most: int = 0) -> DataFrame:
    """(first, n_bytes, nodes): what is read with one seek each: byte ranges that touch, in parts of about READ_BYTES.

    nodes of a row: (offset, byte_size, level, vx, vy, vz), by place.
    """
    most = most or READ_BYTES
    ends = nodes.select((F.col("offset") + F.col("byte_size")).alias("offset"), F.lit(1).alias("touched")).distinct()
    marked = nodes.join(ends, "offset", "left").withColumn("new", F.when(F.col("touched").isNull(), 1).otherwise(0))
    grouped = running(marked, "offset", "new", "grp")
    own = F.struct("offset", "byte_size", *_KEY)
    part = F.expr(f"offset div {most}")
    return grouped.groupBy("grp", part.alias("part")).agg(F.min("offset").alias("first"), F.sum("byte_size").alias("n_bytes"), F.sort_array(F.collect_list(own)).alias("nodes")).drop("grp", "part")


def query(spark: SparkSession, path: str, lo=None, hi=None, levels: range | None = None, resolution: float | None = None, names: list[str] | None = None) -> PointCloud:
    """Points of a box (two or three axes, ends included) at given levels or as fine as a resolution, with their node's key.

    Pages and nodes outside are not read; ranges of nodes that touch are read at once and cut up again by the task.
    """
    if levels is not None and resolution is not None:
        raise ValueError("levels or a resolution, not both")
    full, h, info = _front(spark, path)
    if resolution is not None:
        levels = spatial.levels_of(info["spacing"], resolution)
    box = (tuple(lo), tuple(hi)) if lo is not None else None
    nodes = index(spark, path, box, None if levels is None else levels.stop)
    if levels is not None:
        nodes = nodes.where((F.col("level") >= levels.start) & (F.col("level") < levels.stop))
    schema = dims.point_schema(h.fmt, h.extra, index=False)
    pick = [f for f in schema.fields if names is None or f.name in names or box and f.name in AXES]
    out = T.StructType([*[T.StructField(k, T.IntegerType()) for k in _KEY], *pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = las._store(full)
        with store.open_input_file(at) as f:
            for b in batches:
                for first, n, inside in zip(b.column("first").to_pylist(), b.column("n_bytes").to_pylist(), b.column("nodes"), strict=True):
                    f.seek(first)
                    key = {k: inside.values.field(k).to_numpy(zero_copy_only=False) for k in ("byte_size", *_KEY)}
                    ends = np.cumsum(key["byte_size"], dtype=np.int64) // h.dtype.itemsize
                    step = max(1, READ_BYTES // h.dtype.itemsize)
                    for done in range(0, n // h.dtype.itemsize, step):  # one node may hold more than a task should
                        own = np.frombuffer(raw := f.read(min(step * h.dtype.itemsize, n - done * h.dtype.itemsize)), h.dtype, len(raw) // h.dtype.itemsize)
                        if len(own) < min(step, n // h.dtype.itemsize - done):
                            raise IncompatibleData(f"{path} ends within a node at {first}")
                        node = np.searchsorted(ends, np.arange(done, done + len(own)), "right")
                        cols = lasfile.columns_of(own, h.fmt, [x.name for x in pick])
                        yield pa.RecordBatch.from_arrays([*[pa.array(key[k][node].astype(np.int32)) for k in _KEY], *[las._array(cols[x.name], x.dataType) for x in pick]], out.names)

    dealt = reads(nodes).repartition(max(1, spark.sparkContext.defaultParallelism))
    cloud = PointCloud(dealt.mapInArrow(run, out), h.fmt, tuple(h.scales), tuple(h.offsets), h.version, h.extra, tuple(r for r in h.records if r.user_id != "copc"), h.meta())
    return spatial.box(cloud, lo, hi) if box else cloud
