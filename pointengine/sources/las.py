"""LAS files as DataFrames.  Spark lists the files; tasks read ranges of them and decode these in Arrow batches."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import dims
from ..errors import CodecError, IncompatibleData
from ..operators.cloud import PointCloud
from . import lasfile

#: Points decoded into one Arrow batch.
BATCH = 1 << 17
#: Bytes of a file's beginning that are read at once; header and records beyond are read after them.
FIRST_BYTES = 1 << 16
#: Bytes of points in one range of a file, about, and tasks that ranges are dealt to, at most.
RANGE_BYTES, RANGE_TASKS = 64 << 20, 50000


def files(spark: SparkSession, path: str, glob: str = "*.la[sz]") -> DataFrame:
    """(path, length, content) of one file or the files of a folder, through Spark's own readers, so any store works."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a full path names, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1) if scheme == "s3a" else path, safe=":/@"))


def reachable(path: str) -> None:
    """Raises where tasks cannot open the store on their own."""
    try:
        _store(path)
    except (pa.ArrowException, OSError, ImportError) as e:
        raise IncompatibleData(f"{path}: no store that tasks can write to") from e


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files; tasks then read the bytes they need.  Files of a store that only Spark reaches come
    whole, as (path, length, content)."""
    found = files(spark, path)
    try:
        store, at = _store(_whole(spark, path.split("*")[0]))
        store.get_file_info(at)
    except (pa.ArrowException, OSError, ImportError):
        return found.select("path", "length", "content")
    return found.select("path", "length")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, str, pa.NativeFile]]:
    """Row, path and open file of every row."""
    whole = batch.column("content") if "content" in batch.schema.names else None
    for k, p in enumerate(batch.column("path").to_pylist()):
        if whole is None:
            store, at = _store(p)
            with store.open_input_file(at) as f:
                yield k, p, f
        else:
            yield k, p, pa.BufferReader(whole[k].as_buffer())


def _beginning(f: pa.NativeFile, records: bool) -> tuple[bytes, bytes]:
    """The bytes before the first point, and those from the extended records on, if asked for."""
    f.seek(0)
    raw = f.read(FIRST_BYTES)
    at = lasfile.Header.points_at(raw)
    raw = raw[:at] if at <= len(raw) else raw + f.read(at - len(raw))
    h = lasfile.Header.read(raw, b"")
    if not records or not h.evlr_count or h.evlr_start >= f.size():
        return raw, b""
    f.seek(h.evlr_start)
    return raw, f.read()


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: what its header says, without reading points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, p, f in _opened(b):
                h = lasfile.Header.read(*_beginning(f, True))
                rows.append({"path": p, "version": h.version, "point_format": h.fmt, "points": h.count, "scales": list(h.scales), "offsets": list(h.offsets), "mins": list(h.mins), "maxs": list(h.maxs), "returns": list(h.returns), "compressed": h.compressed, "crs": str(lasfile.crs_of(h.records) or ""), "software": h.software, "system": h.system, "guid": str(uuid.UUID(bytes_le=bytes(h.guid))), "source_id": h.source_id, "encoding": h.encoding, "created": h.created})
            yield pa.RecordBatch.from_pylist(rows, schema=_HEADERS)

    return _listed(spark, path).mapInArrow(run, "path string, version string, point_format int, points long, scales array<double>, offsets array<double>, mins array<double>, maxs array<double>, returns array<long>, compressed boolean, crs string, software string, system string, guid string, source_id int, encoding int, created date")


_HEADERS = pa.schema([("path", pa.string()), ("version", pa.string()), ("point_format", pa.int32()), ("points", pa.int64()), *[(n, pa.list_(pa.float64())) for n in ("scales", "offsets", "mins", "maxs")], ("returns", pa.list_(pa.int64())), ("compressed", pa.bool_()), ("crs", pa.string()), ("software", pa.string()), ("system", pa.string()), ("guid", pa.string()), ("source_id", pa.int32()), ("encoding", pa.int32()), ("created", pa.date32())])


def vlrs(spark: SparkSession, path: str) -> DataFrame:
    """One row a metadata record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("user_id", pa.string()), ("record_id", pa.int32()), ("description", pa.string()), ("data", pa.binary()), ("late", pa.bool_())])
        for b in batches:
            rows = [{"path": p, "user_id": r.user_id, "record_id": r.record_id, "description": r.description, "data": r.data, "late": r.extended} for _, p, f in _opened(b) for r in lasfile.Header.read(*_beginning(f, True)).records]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return _listed(spark, path).mapInArrow(run, "path string, user_id string, record_id int, description string, data binary, late boolean")


def extra_dims(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, user dimension and element: its extremes as the file's record has them, raw and without no-data, null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("name", pa.string()), ("element", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])
        for b in batches:
            rows = []
            for _, p, f in _opened(b):
                for e in lasfile.Header.read(*_beginning(f, True)).extra:
                    rows += [{"path": p, "name": e.name, "element": k, "lo": float(e.mins[k]) if e.mins else None, "hi": float(e.maxs[k]) if e.maxs else None} for k in range(e.count)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return _listed(spark, path).mapInArrow(run, "path string, name string, element int, lo double, hi double")


def _array(v: np.ndarray, t: T.DataType) -> pa.Array:
    if isinstance(t, T.ArrayType):
        flat = _array(np.ascontiguousarray(v).reshape(-1), t.elementType)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), flat)
    kind = {"byte": np.int8, "short": np.int16, "integer": np.int32, "long": np.int64, "float": np.float32, "double": np.float64}[t.typeName()]
    v = np.ascontiguousarray(v)
    if v.dtype == np.uint64 and len(v) and v.max() >= 1 << 63:
        raise OverflowError("a 64-bit value above the largest signed one")
    return pa.array(v.astype(kind))


def _first_header(spark: SparkSession, path: str) -> lasfile.Header:
    """The first file's header and records; a task cuts them out, so the points stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, f in _opened(b):
                head, late = _beginning(f, True)
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([late], pa.binary())], ["head", "late"])
                return

    got = _listed(spark, path).mapInArrow(run, "head binary, late binary").limit(1).collect()
    if not got:
        raise IncompatibleData(f"no LAS file at {path}")
    return lasfile.Header.read(bytes(got[0].head), bytes(got[0].late))


def load(spark: SparkSession, path: str, names: list[str] | None = None, where: tuple[tuple[float, ...], tuple[float, ...]] | None = None) -> PointCloud:
    """The files as one cloud: its points with their index, and what the header and records say of them.

    Filter, convert or append it, and write() it: format, scales, user dimensions and records go along.
    """
    h = _first_header(spark, path)
    codecs = {(c.record.user_id, c.record.record_id) for c in lasfile.CODECS.values() if isinstance(c, lasfile.Codec)}
    own = tuple(r for r in h.records if (r.user_id, r.record_id) not in {("LASF_Spec", 4), *codecs})
    return PointCloud(_points(spark, path, h, names, where), h.fmt, tuple(h.scales), tuple(h.offsets), h.version, h.extra, own, h.meta())


def read(spark: SparkSession, path: str, names: list[str] | None = None, where: tuple[tuple[float, ...], tuple[float, ...]] | None = None) -> DataFrame:
    """Points of all files, with the file's path and their index in it.

    names: dimensions to decode, all by default.  where: a box (mins, maxs); files whose header box lies outside are
    not read, and points outside are left for the caller's filter.  All files have one point format; coordinates of files
    with other scales than the first follow those.  A file cut short gives the points that it has.

    Headers are read first and cut files into ranges (path, first, n) of about RANGE_BYTES, which tasks read on their own; a
    file of compressed points is cut at its chunks, or is one range where its codec knows none, as is one of a store that only Spark reaches.
    """
    return _points(spark, path, _first_header(spark, path), names, where)


def _ranges(where: tuple[tuple[float, ...], tuple[float, ...]] | None, codecs: dict):
    """(path, first, n): the parts of every file whose box meets where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_pylist()
            for k, p, f in _opened(b):
                h = lasfile.Header.read(*_beginning(f, False))
                if where and any(hi < lo2 or lo > hi2 for lo, hi, lo2, hi2 in zip(h.mins, h.maxs, *where, strict=False)):
                    continue
                n = h.count if h.compressed else min(h.count, max(0, length[k] - h.offset) // h.record_size)
                step = max(n, 1) if h.compressed or "content" in b.schema.names else max(1, RANGE_BYTES // h.record_size)
                first = np.arange(0, n, step)
                if h.compressed and (codec := lasfile.codec_of(h, codecs)) and "content" not in b.schema.names:
                    chunks, first, held = codec.chunks(f, h), [], RANGE_BYTES
                    for at, _, _, size in chunks:  # whole chunks, up to RANGE_BYTES
                        if held + size > RANGE_BYTES:
                            first.append(at)
                            held = 0
                        held += size
                    first = np.array(first, np.int64)
                    step = np.diff(np.append(first, n))
                cols = [pa.array([p] * len(first), pa.string()), pa.array(first), pa.array(np.minimum(step, n - first))]
                more = [pa.array([b.column("content")[k].as_py()] * len(first), pa.binary())] if "content" in b.schema.names else []
                yield pa.RecordBatch.from_arrays(cols + more, ["path", "first", "n", "content"][: len(cols + more)])

    return run


def decoded(f: pa.NativeFile, h: lasfile.Header, first: int, n: int, codecs: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first, packed records) of points of a file, BATCH or a compressed chunk at a time."""
    size = h.dtype.itemsize
    data = None
    codecs = lasfile.CODECS if codecs is None else codecs
    if h.compressed and (codec := lasfile.codec_of(h, codecs)):
        for at, m, place, packed in codec.chunks(f, h):
            if at + m > first and at < first + n:
                f.seek(place)
                own = np.frombuffer(codec.unpack(f.read(packed), h, m), h.dtype, m)
                lo, hi = max(at, first), min(at + m, first + n)
                yield lo, own[lo - at : hi - at]
        return
    if h.compressed:
        f.seek(0)
        data = lasfile.decompress(f.read(), h, first, n, codecs)
    for lo in range(first, first + n, BATCH):
        m = min(BATCH, first + n - lo)
        if data is not None:
            yield lo, np.frombuffer(data, h.dtype, m, (lo - first) * size)
        else:
            f.seek(h.offset + lo * size)
            yield lo, np.frombuffer(f.read(m * size), h.dtype)


def columns_like(own: np.ndarray, h: lasfile.Header, first: lasfile.Header, names: list[str]) -> dict[str, np.ndarray]:
    """Columns of packed records; coordinates follow the scales of the first file."""
    cols = lasfile.columns_of(own, h.fmt, names)
    if (tuple(h.scales), tuple(h.offsets)) != (tuple(first.scales), tuple(first.offsets)):
        cols |= {a: np.rint((cols[a] * h.scales[i] + h.offsets[i] - first.offsets[i]) / first.scales[i]) for i, a in enumerate("XYZ") if a in cols}
    return cols


def _points(spark: SparkSession, path: str, head: lasfile.Header, names: list[str] | None, where: tuple[tuple[float, ...], tuple[float, ...]] | None) -> DataFrame:
    found = _listed(spark, path)
    size = found.agg(F.sum("length")).first()[0] or 0  # of the listing alone; no byte of a file is read for it
    return points_of(found, head, names, where, min(RANGE_TASKS, size // RANGE_BYTES + 1))


def points_of(found: DataFrame, head: lasfile.Header, names: list[str] | None, where: tuple[tuple[float, ...], tuple[float, ...]] | None, tasks: int) -> DataFrame:
    """Points of the files (path, length) of a table or a stream."""
    schema = dims.point_schema(head.fmt, head.extra)
    pick = [f for f in schema.fields if f.name != "point_idx" and (names is None or f.name in names)]
    out = T.StructType([T.StructField("path", T.StringType()), schema["point_idx"], *pick])
    arrow = [f.name for f in out.fields]
    codecs = dict(lasfile.CODECS)
    fmt, extra, kinds, like = head.fmt, head.extra, [(f.name, f.dataType) for f in pick], head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, count = b.column("first").to_pylist(), b.column("n").to_pylist()
            for k, p, f in _opened(b):
                h = lasfile.Header.read(*_beginning(f, False))
                if h.fmt != fmt:
                    raise IncompatibleData(f"{p} has point format {h.fmt}, others {fmt}")
                h.extra = h.extra or extra
                for lo, own in decoded(f, h, start[k], count[k], codecs):
                    cols = columns_like(own, h, like, [c for c, _ in kinds])
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(own)), pa.array(np.arange(lo, lo + len(own))), *[_array(cols[c], t) for c, t in kinds]], arrow)

    if "content" in found.columns:
        return found.mapInArrow(_ranges(where, codecs), "path string, first long, n long, content binary").mapInArrow(run, out)
    return found.mapInArrow(_ranges(where, codecs), "path string, first long, n long").repartition(tasks).mapInArrow(run, out)


def with_crs(cloud: PointCloud, epsg: int | None = None, wkt: str | None = None, geographic: bool = False) -> PointCloud:
    """The cloud with another reference system; its header says whether that is a WKT text."""
    flags = cloud.meta.encoding & ~16 | (16 if cloud.fmt >= 6 else 0)
    return replace(cloud, records=lasfile.with_crs(cloud.records, cloud.fmt, epsg, wkt, geographic), meta=replace(cloud.meta, encoding=flags))


def write(cloud: PointCloud, path: str, records: list[lasfile.Record] | None = None, codec: str | None = None) -> None:
    """A folder with one complete LAS file a partition, in the store that path names.

    A task packs its points and the header of its own statistics, and writes the file through pyarrow; a store that pyarrow does not
    reach is refused at once.  An empty cloud writes one empty file.  records: those of the cloud, by default; extended ones make the file 1.4.
    codec: the name of a registered codec that packs the points in chunks; files are then named .laz.
    """
    head = head_of(cloud, records)
    packer = None
    if codec is not None:
        packer = lasfile.CODECS.get(codec)
        if not isinstance(packer, lasfile.Codec):
            raise CodecError(f"no codec {codec!r} that writes is registered")
        head |= {"compressed": True, "records": [*(r for r in head["records"] if (r.user_id, r.record_id) != (packer.record.user_id, packer.record.record_id)), packer.record]}
    spark = cloud.df.sparkSession
    reachable(_whole(spark, path))
    register(spark)
    how = base64.b64encode(CloudPickleSerializer().dumps((head, packer))).decode()  # options are texts
    cloud.df.write.format("las_parts").mode("append").option("path", _whole(spark, path)).option("how", how).save()


def head_of(cloud: PointCloud, records: list[lasfile.Record] | None = None) -> dict:
    """The fields of a header for the cloud's files, without statistics."""
    own = cloud.records if records is None else records
    late = any(r.extended for r in own)
    version = max(cloud.version, "1.4") if late else cloud.version
    dims.check_version(version, cloud.fmt)
    return dict(fmt=cloud.fmt, version=version, scales=tuple(cloud.scales), offsets=tuple(cloud.offsets), extra=cloud.extra, records=list(own), **vars(cloud.meta))


def arrays_of(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of a batch; vectors as matrices."""
    return {name: np.stack(v.to_numpy(zero_copy_only=False)) if pa.types.is_list(v.type) and len(v) else v.to_numpy(zero_copy_only=False) for name, v in zip(b.schema.names, b.columns, strict=True)}


def encode_batches(batches: Iterator[pa.RecordBatch], head: dict, codec: lasfile.Codec | None = None) -> Iterator[tuple[str, list]]:
    """(name, buffers) of a task's files, about FILE_BYTES of points each; points are held once, and a file's buffers only until the next is asked for."""
    from pyspark import TaskContext

    part, parts, size, k = TaskContext.get().partitionId(), [], 0, 0

    def out() -> tuple[str, list]:
        h = lasfile.Header(**head)
        h = lasfile.with_statistics(h, [lasfile.statistics(p, h) for p in parts] or [lasfile.statistics(np.zeros(0, h.dtype), h)])
        h.extra = lasfile.with_extremes(h.extra, parts)
        body = [memoryview(p).cast("B") for p in parts]
        front = h.pack()
        if codec:
            body = [codec.body(np.concatenate(parts) if parts else np.zeros(0, h.dtype), h, len(front))]
            front = h.pack(len(body[0]))
        return f"part-{part:05d}-{k:03d}.{'laz' if codec else 'las'}", [front, *body, h.tail()]

    h = lasfile.Header(**head)
    for b in batches:
        if len(b):
            parts.append(lasfile.records_of(arrays_of(b), h, len(b)))
            size += parts[-1].nbytes
        if size >= FILE_BYTES:
            own = out()
            yield own
            own[1].clear()
            parts, size, k = [], 0, k + 1
    if size or part == 0 and k == 0:
        yield out()


#: Bytes of points in one written file, about.
FILE_BYTES = 64 << 20


#: Files renamed at a time when a write is committed.
RENAMES = 32


class PartsSource(DataSource):
    """Writer of points to a folder of whole files; how: the header's fields and the codec, pickled."""

    @classmethod
    def name(cls) -> str:
        return "las_parts"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PartsWriter(self.options["path"], *CloudPickleSerializer().loads(base64.b64decode(self.options["how"])))


class PartsWriter(DataSourceArrowWriter):
    """A task packs its points and writes its files, so no file goes through Spark's rows.  Files get their names when the whole job has succeeded; one that fails takes its files away."""

    def __init__(self, path: str, head: dict, codec: lasfile.Codec | None = None):
        self.path, self.head, self.codec, self.prefix = path, head, codec, uuid.uuid4().hex[:12] + "-"  # files of an earlier write stay beside these

    def _store(self):
        return _store(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        out = []
        for part, buffers in encode_batches(batches, self.head, self.codec):
            tmp = f"{folder}/_{self.prefix}{part}.{uuid.uuid4().hex}"
            with store.open_output_stream(tmp) as f:
                for x in buffers:
                    f.write(x)
            out.append((tmp, f"{folder}/{self.prefix}{part}"))
        return PartsWritten(out)

    def commit(self, messages: list[PartsWritten | None]) -> None:
        store, _ = self._store()
        with ThreadPoolExecutor(RENAMES) as pool:  # a rename waits for the store, not for this machine
            list(pool.map(lambda x: store.move(*x), [f for m in messages if m for f in m.files]))

    def abort(self, messages: list[PartsWritten | None]) -> None:
        store, _ = self._store()
        for m in messages:
            for tmp, _ in m.files if m else ():
                store.delete_file(tmp)


@dataclass
class PartsWritten(WriterCommitMessage):
    """Files of a task, by the names that they have and will get."""

    files: list[tuple[str, str]]


def _whole(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without is below the session's default file system, as for Spark's own writers."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PartsSource)
