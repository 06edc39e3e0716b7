"""``spark.read.format("las")`` and ``df.write.format("las")``: a Python data source over the public LAS format.

Reading: files are packed into partitions of about RANGE_BYTES, or cut into ranges of points (path, first, n), from their lengths alone.  Filters
on X, Y, Z and point_idx are pushed down (register() turns that on for the session): then headers are read first, by a pool of threads, as other file
sources read footers, and files whose box lies outside, or ranges whose indices do, get no partition.  Spark tests every filter again on the
points.  A schema given to the reader, or the option ``names``, says which dimensions are decoded; the option ``range_bytes`` changes the size of
partitions.

Writing: one complete file a task of about FILE_BYTES, named when the job has succeeded.  Options: point_format, version, scales, offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import dims
from ..errors import IncompatibleData
from ..operators.cloud import PointCloud
from . import las, lasfile

#: Headers that are read at a time when filters are pushed down.
READERS = 32
_PUSHED = ("X", "Y", "Z", "point_idx")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it push filters down."""
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def table(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The files' points as the format reads them; names: the dimensions wanted, all by default."""
    register(spark)
    reader = spark.read.format("las")
    return (reader.option("names", ",".join(names)) if names else reader).load(las._whole(spark, path))


def _found(path: str) -> list[fs.FileInfo]:
    """The LAS files at a path: one file, or those below a folder, by name."""
    store, at = las._store(path if ":" in path.split("/")[0] else f"file:{path}")
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise IncompatibleData(f"no LAS file at {path}")
    inside = store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = ("_", ".")
    return sorted((f for f in inside if f.type == fs.FileType.File and f.extension.lower() in ("las", "laz") and not f.base_name.startswith(hidden)), key=lambda f: f.path)


@dataclass
class Part(InputPartition):
    """Shares of files: (path, first, n); n < 0: the points of share first of -n."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def _head(self) -> tuple[lasfile.Header, fs.FileSystem]:
        path = self.options["path"]
        store, _ = las._store(path if ":" in path.split("/")[0] else f"file:{path}")
        found = _found(path)
        if not found:
            raise IncompatibleData(f"no LAS file at {path}")
        with store.open_input_file(found[0].path) as f:
            return lasfile.Header.read(*las._beginning(f, True)), store

    def schema(self) -> T.StructType:
        h, _ = self._head()
        wanted = [n.strip() for n in self.options.get("names", "").split(",") if n.strip()]
        full = dims.point_schema(h.fmt, h.extra)
        keep = [f for f in full.fields if not wanted or f.name in wanted]
        return T.StructType([T.StructField("path", T.StringType()), *keep])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        h, store = self._head()
        return LasReader(self.options["path"], schema, h, store, int(self.options.get("range_bytes", las.RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        three = lambda key, v: tuple(float(x) for x in o[key].split(",")) if key in o else v
        fmt = int(o.get("point_format", 3))
        user = tuple(dims.ExtraDim(f.name, f.metadata["kind"], f.metadata["count"], *(tuple(f.metadata[k]) if k in f.metadata else None for k in ("scales", "offsets")), f.metadata.get("no_data")) for f in schema.fields if "kind" in f.metadata)
        head = dict(fmt=fmt, version=o.get("version", dims.preferred_version(fmt)), scales=three("scales", (0.01,) * 3), offsets=three("offsets", (0.0,) * 3), extra=user)
        dims.check_version(head["version"], fmt)
        return LasWriter(o["path"] if ":" in o["path"].split("/")[0] else f"file:{o['path']}", head, overwrite)


class LasReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, head: lasfile.Header, store: fs.FileSystem, size: int):
        self.path, self.schema, self.head, self.store, self.range = path, schema, head, store, size
        self.low = dict.fromkeys(_PUSHED, -math.inf)
        self.high = dict.fromkeys(_PUSHED, math.inf)
        known = set(dims.point_schema(head.fmt, head.extra).names) | {"path"}
        if missing := [f.name for f in schema.fields if f.name not in known]:
            raise IncompatibleData(f"files at {path} have no {', '.join(missing)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes bounds of coordinates and indices; all filters are left to Spark as well."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _PUSHED:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low[name] = max(self.low[name], f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high[name] = min(self.high[name], f.value)
                if isinstance(f, In) and f.value:
                    self.low[name], self.high[name] = max(self.low[name], min(f.value)), min(self.high[name], max(f.value))
            yield f

    def _opened(self, path: str, size: int) -> list[tuple[str, int, int, int]]:
        """(path, first, n, bytes) of the ranges of a file that can meet the filters."""
        with self.store.open_input_file(path) as f:
            h = lasfile.Header.read(*las._beginning(f, False))
        for k, a in enumerate("XYZ"):  # raw coordinates follow the first file's scales; one unit is left for rounding
            lo, hi = sorted(((v - self.head.offsets[k]) / self.head.scales[k] for v in (h.mins[k], h.maxs[k])))
            if h.count and (lo - 1 > self.high[a] or hi + 1 < self.low[a]):
                return []
        n = h.count if h.compressed else min(h.count, max(0, size - h.offset) // h.record_size)
        first = int(max(0, min(n, self.low["point_idx"])))
        last = int(max(first, min(n, self.high["point_idx"] + 1)))
        step = max(n, 1) if h.compressed else max(1, self.range // h.record_size)
        cuts = [*range(first, last, step), last]
        return [(path, a, b - a, (b - a) * h.record_size) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def partitions(self) -> list[Part]:
        found = _found(self.path)
        if any(map(math.isfinite, [*self.low.values(), *self.high.values()])):
            with ThreadPoolExecutor(READERS) as pool:
                shares = [s for part in pool.map(lambda f: self._opened(f.path, f.size), found) for s in part]
        else:
            shares = []
            for f in found:
                m = 1 if f.extension.lower() == "laz" else -(-f.size // self.range) or 1
                shares += [(f.path, k, -m, f.size // m) for k in range(m)]
        out, size = [Part()], 0
        for path, first, n, weight in shares:
            if out[-1].files and size + weight > self.range:
                out.append(Part())
                size = 0
            out[-1].files.append((path, first, n))
            size += weight
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds = [(f.name, f.dataType) for f in self.schema.fields if f.name not in ("path", "point_idx")]
        scheme = self.path.split(":")[0] + ":" if ":" in self.path.split("/")[0] else ""
        for path, first, n in partition.files:
            with self.store.open_input_file(path) as f:
                h = lasfile.Header.read(*las._beginning(f, False))
                if h.fmt != self.head.fmt:
                    raise IncompatibleData(f"{path} has point format {h.fmt}, others {self.head.fmt}")
                h.extra = h.extra or self.head.extra
                if n < 0:
                    total = h.count if h.compressed else min(h.count, max(0, f.size() - h.offset) // h.record_size)
                    first, n = total * first // -n, total * (first + 1) // -n - total * first // -n
                for at, own in las.decoded(f, h, first, n):
                    cols = las.columns_like(own, h, self.head, [c for c, _ in kinds])
                    made = {"path": pa.array([f"{scheme}{path}"] * len(own), pa.string()), "point_idx": pa.array(np.arange(at, at + len(own)))} | {c: las._array(cols[c], t) for c, t in kinds}
                    yield pa.RecordBatch.from_arrays([made[x.name] for x in self.schema.fields], [x.name for x in self.schema.fields])


class LasWriter(las.PartsWriter):
    def __init__(self, path: str, head: dict, overwrite: bool):
        super().__init__(path, head)
        self.overwrite = overwrite

    def commit(self, messages: list[las.PartsWritten | None]) -> None:
        store, folder = self._store()
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.extension == "las" and not f.base_name.startswith("_"):
                    store.delete_file(f.path)
        super().commit(messages)


def open_las(spark: SparkSession, path: str, mode: str = "r", header: PointCloud | None = None) -> PointCloud | Sink:
    """``r``: the files as a cloud; ``w``: a sink for new files like ``header``; ``a``: a sink that adds points to the files or to the one file.

    A header belongs to ``w`` alone, which needs it.
    """
    if mode not in ("r", "w", "a"):
        raise ValueError(f"mode {mode!r}: r, w or a")
    if (mode == "w") != (header is not None):
        raise ValueError("a header goes with mode w" if header is not None else "mode w needs a header")
    if mode == "r":
        return las.load(spark, path)
    return Sink(path, mode, header if header is not None else las.load(spark, path))


class Sink:
    """Takes clouds of one point format; coordinates of others follow the scales of the first."""

    def __init__(self, path: str, mode: str, like: PointCloud):
        self.path, self.mode, self.like, self.open = path, mode, like, True

    def write(self, cloud: PointCloud) -> None:
        from . import onefile

        if not self.open:
            raise ValueError("the sink is closed")
        if cloud.fmt != self.like.fmt:
            raise IncompatibleData(f"point formats {self.like.fmt} and {cloud.fmt}")
        if self.path.lower().endswith(".las"):
            put = onefile.append_file if self.mode == "a" else onefile.write_file
            put(onefile.like(cloud, self.like), self.path)
            self.mode = "a"
        else:
            las.write(onefile.like(cloud, self.like), self.path)

    def close(self) -> None:
        self.open = False

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
