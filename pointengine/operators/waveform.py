"""Waveform packets: gather, deduplicate, runs, repack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def packet_number(size: str = "wavepacket_size", offset: str = "wavepacket_offset"):
    return F.expr(f"{offset} div {size}")


def gather(points: DataFrame, packets: DataFrame, samples: int) -> DataFrame:
    """Points with their packet's samples; zeros where wavepacket_index is 0 or the packet is missing.

    packets: (packet, waveform).  The side is left to the optimizer, which broadcasts it only if it is small.
    """
    key = F.when(F.col("wavepacket_index") != 0, packet_number())
    zero = F.array_repeat(F.lit(0.0).cast("float"), samples)
    return points.withColumn("packet", key).join(packets, "packet", "left").withColumn("waveform", F.coalesce("waveform", zero))


def missing_descriptors(points: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Indices in use whose descriptor record (id = index + 99) is missing."""
    used = points.where("wavepacket_index <> 0").select(F.col("wavepacket_index").cast("int").alias("wavepacket_index")).distinct()
    return used.join(descriptors, used["wavepacket_index"] + 99 == descriptors["record_id"], "left_anti")


def numbered(points: DataFrame) -> DataFrame:
    """(packet, new_index): packets in use, numbered from 0 in order of their old number."""
    return ranked(points.where("wavepacket_index <> 0").select(packet_number().alias("packet")).distinct(), "packet", "new_index")


def runs(packets: DataFrame, column: str = "packet") -> DataFrame:
    """(first, last) of every run of consecutive distinct numbers."""
    island = ranked(packets, column, "_n").withColumn("_g", F.col(column) - F.col("_n"))
    return island.groupBy("_g").agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("_g")


def repacked(points: DataFrame) -> DataFrame:
    """Points whose offsets follow the renumbered packets."""
    new = numbered(points)
    joined = points.withColumn("packet", F.when(F.col("wavepacket_index") != 0, packet_number())).join(new, "packet", "left")
    return joined.withColumn("wavepacket_offset", F.coalesce(F.col("new_index") * F.col("wavepacket_size"), F.lit(0)).cast("long")).drop("packet", "new_index")


def sample_kind(bits: int) -> str:
    """Type of the samples of a descriptor."""
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits")
    return f"u{bits // 8}"


def checked_offsets(points: DataFrame, size: int) -> DataFrame:
    """Points with a waveform whose packets have one size and one common remainder; an error names the first that has not."""
    used = points.where("wavepacket_index <> 0")
    rest = used.agg(F.min(F.expr(f"wavepacket_offset % {size}")).alias("lo"), F.max(F.expr(f"wavepacket_offset % {size}")).alias("hi"), F.count_if(F.col("wavepacket_size") != size).alias("odd")).first()
    if rest.odd:
        raise ValueError(f"{rest.odd} packets are not of {size} bytes")
    if rest.lo != rest.hi:
        raise ValueError("packet offsets with different remainders are not supported")
    return used
