"""Waveform payload: the ``.wdp`` file beside a LAS file, read by the runs of packets that points use, and written by rank.

A packet has the samples of one descriptor (records 100 to 354): uncompressed, 8, 16, 32 or 64 bits each, all descriptors of one
layout.  The packet of an offset is its true byte place; offsets may share a remainder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import waveform
from ..operators.cloud import PointCloud
from ..operators.ranks import ranked
from . import las, lasfile, onefile, scratch

#: Bytes of packets that one task reads, about.
RUN_BYTES = 64 << 20
_EXTERNAL, _INTERNAL = 4, 2  # fixed values of the header's global encoding
_TYPES = {8: ("u1", np.int16, pa.int16(), "smallint"), 16: ("<u2", np.int32, pa.int32(), "int"), 32: ("<u4", np.int64, pa.int64(), "bigint"), 64: ("<u8", np.int64, pa.int64(), "bigint")}


@dataclass(frozen=True)
class Layout:
    """Samples of a packet."""

    bits: int
    samples: int

    @property
    def size(self) -> int:
        return self.bits // 8 * self.samples

    @property
    def kind(self) -> str:
        return f"array<{_TYPES[self.bits][3]}>"


def layout_of(records: tuple[lasfile.Record, ...]) -> Layout:
    """The one layout of a cloud's descriptors."""
    found = [lasfile.parsed(r) for r in records if r.user_id == "LASF_Spec" and 100 <= r.record_id < 355]
    if not found:
        raise ValueError("no waveform packet descriptors among the records")
    if any(d["compression"] for d in found):
        raise ValueError("compressed waveforms are not supported")
    kinds = {(d["bits"], d["samples"]) for d in found}
    if len(kinds) > 1:
        raise ValueError(f"descriptors of several layouts: {sorted(kinds)}")
    bits, samples = kinds.pop()
    waveform.sample_kind(bits)
    return Layout(bits, samples)


def _decoded(raw: bytes, n: int, form: Layout) -> pa.Array:
    got, wide, arrow, _ = _TYPES[form.bits]
    v = np.frombuffer(raw, got, n * form.samples)
    if form.bits == 64 and len(v) and v.max() >= 1 << 63:
        raise OverflowError("a 64-bit sample above the largest signed one")
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * form.samples), pa.array(v.astype(wide), arrow))


def packets(spark: SparkSession, path: str, form: Layout, first_byte: int = 0, used: DataFrame | None = None) -> DataFrame:
    """(packet, waveform) of a payload file, packet k at byte first_byte + k * size.

    used: (packet) of those that are wanted.  Runs of consecutive ones are found by rank, cut to RUN_BYTES and dealt to tasks, which read each with
    one seek; without it the whole file is cut so.  A file that ends before a packet does raises.
    """
    path = las._whole(spark, path)
    store, at = las._store(path)
    length = store.get_file_info(at).size
    if length is None:
        raise ValueError(f"no payload file at {path}")
    step = max(1, RUN_BYTES // form.size)
    if used is None:
        whole = max(0, length - first_byte) // form.size
        runs = spark.range(0, whole, step).select(F.col("id").alias("first"), F.least(F.col("id") + step, F.lit(whole)).alias("stop"))
    else:
        runs = waveform.runs(used.where(F.col("packet").isNotNull()).select("packet").distinct())
        runs = runs.select(F.explode(F.sequence("first", "last", F.lit(step))).alias("first"), F.col("last"))
        runs = runs.select("first", F.least(F.col("first") + step - 1, F.col("last")).alias("last")).select("first", (F.col("last") + 1).alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = las._store(path)
        with store.open_input_file(at) as f:
            for b in batches:
                for lo, hi in zip(b.column("first").to_pylist(), b.column("stop").to_pylist(), strict=True):
                    f.seek(first_byte + lo * form.size)
                    raw = f.read((hi - lo) * form.size)
                    if len(raw) < (hi - lo) * form.size:
                        raise ValueError(f"{path} ends within packets {lo} to {hi - 1}: {len(raw)} of {(hi - lo) * form.size} bytes")
                    for k in range(lo, hi, 4096):
                        n = min(4096, hi - k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), _decoded(raw[(k - lo) * form.size : (k - lo + n) * form.size], n, form)], ["packet", "waveform"])

    tasks = max(1, min(las.RANGE_TASKS, length // RUN_BYTES + 1))
    return runs.repartition(tasks).mapInArrow(run, f"packet long, waveform {form.kind}")


def gathered(cloud: PointCloud, path: str) -> PointCloud:
    """The cloud's points with their samples as ``waveform``, zeros where wavepacket_index is 0; only packets in use are read."""
    if not cloud.meta.encoding & _EXTERNAL:
        raise ValueError("the waveforms of this cloud are not in an external .wdp file")
    form = layout_of(cloud.records)
    spark = cloud.df.sparkSession
    used = waveform.checked_offsets(cloud.df, form.size)
    rest = used.agg(F.min(F.col("wavepacket_offset") % form.size)).first()[0] or 0
    used = used.select(F.expr(f"wavepacket_offset div {form.size}").alias("packet"))
    got = packets(spark, path, form, rest, used)
    key = F.when(F.col("wavepacket_index") != 0, F.expr(f"wavepacket_offset div {form.size}"))
    zero = F.array_repeat(F.lit(0), form.samples).cast(form.kind)
    df = cloud.df.withColumn("packet", key).join(got, "packet", "left").withColumn("waveform", F.coalesce("waveform", zero)).drop("packet")
    return replace(cloud, df=df)


def write(cloud: PointCloud, waves: DataFrame, path: str) -> None:
    """One ``.las`` file and its ``.wdp`` beside it.

    waves: (packet, waveform), packet by the cloud's own offsets.  Packets in use are written once each, in order, at offset rank * size; points get the
    new offsets and sizes, the header the flag of an external payload.  Both files get their names at the end, the payload first.
    """
    form = layout_of(cloud.records)
    spark = cloud.df.sparkSession
    target = onefile.local(spark, path)
    stem = os.path.splitext(target)[0]
    waveform.checked_offsets(cloud.df, form.size)
    new = scratch.folder(spark, "ranks")
    key = F.expr(f"wavepacket_offset div {form.size}")
    ranked(cloud.df.where("wavepacket_index <> 0").select(key.alias("packet")).distinct(), "packet", "rank").write.parquet(new)
    ranks = spark.read.parquet(new)
    asked = ranks.join(waves.select("packet", F.col("waveform").alias("w")), "packet", "left")
    kind, samples = _TYPES[form.bits][0], form.samples
    top = (1 << form.bits) - 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("rank").to_numpy()
            if b.column("w").null_count or not len(at):
                if len(at):
                    raise ValueError(f"packet {b.column('packet').filter(b.column('w').is_null())[0]} is used but not given")
                continue
            w = b.column("w")
            flat = w.flatten().to_numpy(zero_copy_only=False)
            if (np.diff(w.offsets.to_numpy()) != samples).any():
                raise ValueError(f"packets are of {samples} samples")
            if len(flat) and (flat.min() < 0 or flat.max() > top):
                raise OverflowError(f"samples outside 0..{top}")
            v = flat.astype(kind).reshape(-1, samples)
            cut = np.flatnonzero(np.append(True, np.diff(at) != 1))
            for a, z in zip(cut, np.append(cut[1:], len(at)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(at[a]) * form.size]), pa.array([v[a:z].tobytes()], pa.binary())], ["at", "content"])

    n = ranks.count()
    tmp = f"{stem}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        with open(tmp, "wb") as f:
            f.truncate(n * form.size)
        done = onefile.put(asked.repartitionByRange("rank").sortWithinPartitions("rank").mapInArrow(pack, "at long, content binary"), tmp)
        if done != n * form.size:
            raise ValueError(f"{done} bytes of payload written, {n * form.size} expected: a packet is given more than once")
        points = cloud.df.withColumn("packet", F.when(F.col("wavepacket_index") != 0, key)).join(ranks, "packet", "left").drop("packet")
        points = points.withColumns({"wavepacket_offset": F.coalesce(F.col("rank") * form.size, F.lit(0)).cast("long"), "wavepacket_size": F.when(F.col("wavepacket_index") != 0, F.lit(form.size)).otherwise(F.lit(0)).cast("long")}).drop("rank")
        flags = (cloud.meta.encoding & ~_INTERNAL) | (_EXTERNAL if n else 0)
        onefile.write_file(replace(cloud, df=points, meta=replace(cloud.meta, encoding=flags)), path, beside=((tmp, f"{stem}.wdp"),))
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def load(spark: SparkSession, path: str) -> PointCloud:
    """A LAS file with the samples of the payload beside it."""
    cloud = las.load(spark, path)
    if not dims.waveform_capable(cloud.fmt):
        return cloud
    return gathered(cloud, f"{os.path.splitext(path)[0]}.wdp")
