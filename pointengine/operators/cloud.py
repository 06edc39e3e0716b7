"""A point table with its header constants, and the operations on whole clouds."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..errors import IncompatibleData, UnknownDimension
from ..functions import exprs
from ..plans import dsl

AXES = ("X", "Y", "Z")
#: Indices of a list that are sent to all tasks, at most.
TAKEN = 1 << 18


@dataclass(frozen=True)
class PointCloud:
    """df: points, bit-fields packed or unpacked; fmt, scales and offsets: what the header says of them."""

    df: DataFrame
    fmt: int = 3
    scales: tuple[float, float, float] = (0.01, 0.01, 0.01)
    offsets: tuple[float, float, float] = (0.0, 0.0, 0.0)
    version: str = "1.2"
    extra: tuple[dims.ExtraDim, ...] = ()
    #: Metadata records of the file, as the LAS reader gives and the writer takes them.
    records: tuple = ()
    meta: dims.FileMeta = dims.FileMeta()

    def scaled(self) -> dict[str, tuple[Column, float, float]]:
        return {a.lower(): (F.col(a), s, o) for a, s, o in zip(AXES, self.scales, self.offsets, strict=True)}

    def fields(self) -> dict[str, Column]:
        """Every name that can be asked for: columns, sub-fields of packed containers, scaled user dimensions, x, y, z.  df has the
        raw values of scaled ones."""
        own = {c: F.col(c) for c in self.df.columns}
        bits = {b: exprs.unpack(F.col(c), m) for b, (c, m) in dims.bit_fields(self.fmt).items() if c in own and b not in own}
        user = {e.name: exprs.scale(own[e.name], e.scales[0], e.offsets[0]) if e.count == 1 else exprs.scaled_vector(own[e.name], e.scales, e.offsets) for e in self.extra if e.scales and e.name in own}
        return own | bits | user | {k: exprs.scale(*v) for k, v in self.scaled().items()}

    def column(self, name: str) -> Column:
        f = self.fields()
        name = dims.ALIASES.get(name, name)
        if name not in f:
            raise UnknownDimension(f"{name!r}; known are {', '.join(f)}")
        return f[name]

    def select(self, *names: str) -> DataFrame:
        return self.df.select(*[self.column(n).alias(n) for n in names])

    def filter(self, what: str | Column) -> PointCloud:
        cond = dsl.where(what, {k: v for k, v in self.fields().items() if k not in ("x", "y", "z")}, self.scaled()) if isinstance(what, str) else what
        return replace(self, df=self.df.where(cond))

    def unpacked(self) -> PointCloud:
        """Sub-fields instead of their containers: the layout for storage, as filters on it are pushed down."""
        bits = dims.bit_fields(self.fmt)
        held = {c for c, _ in bits.values()}
        f = self.fields()
        return replace(self, df=self.df.select(*[F.col(c) for c in self.df.columns if c not in held], *[f[b].alias(b) for b in bits if b in f]))

    def add_dims(self, *new: dims.ExtraDim) -> PointCloud:
        """User dimensions, filled with zeros."""
        zero = {e.name: (F.lit(0) if e.count == 1 else F.array_repeat(F.lit(0), e.count)).cast(dims.spark_type(e.kind, e.count)) for e in new}
        return replace(self, df=self.df.withColumns(zero), extra=(*self.extra, *new))

    def remove_dims(self, *names: str) -> PointCloud:
        for n in names:
            if n in dims.dimension_names(self.fmt) or n in dict(dims.layout(self.fmt)):
                raise IncompatibleData(f"{n!r} belongs to point format {self.fmt}")
            if n not in self.df.columns:
                raise UnknownDimension(n)
        return replace(self, df=self.df.drop(*names), extra=tuple(e for e in self.extra if e.name not in names))

    def convert(self, fmt: int, version: str | None = None) -> PointCloud:
        """Another point format: same-named dimensions, zeros for new ones, an error where a value does not fit."""
        version = version or max(self.version, dims.preferred_version(fmt))
        dims.check_version(version, fmt)
        have, bits, kinds = self.fields(), dims.bit_fields(fmt), dict(dims.layout(fmt))
        old, old_bits = dict(dims.layout(self.fmt)), dims.bit_fields(self.fmt)
        cols = []
        for n in dims.dimension_names(fmt):
            v = have.get(n, F.lit(0))
            low, high = dims.limits(n, kinds, bits)
            if n in have and math.isfinite(high):
                was = dims.limits(n, old, old_bits) if n in old or n in old_bits else (-math.inf, math.inf)
                typed = dims.type_limits(self.df.schema[n].dataType) if n in self.df.columns else was
                if low > max(was[0], typed[0]) or high < max(was[1], typed[1]):  # not every value of the column fits
                    v = F.when((v >= F.lit(int(low))) & (v <= F.lit(int(high))), v).when(v.isNotNull(), F.raise_error(F.lit(f"{n} outside {int(low)}..{int(high)}")).cast("int"))
            cols.append(v.cast(dims.spark_type(kinds.get(n, "u1"))).alias(n))
        return replace(self, df=self.df.select(*cols, *[F.col(e.name) for e in self.extra]), fmt=fmt, version=version)

    def rescaled(self, scales: tuple[float, float, float], offsets: tuple[float, float, float]) -> PointCloud:
        new = {a: exprs.unscale(exprs.scale(F.col(a), s, o), s2, o2) for a, s, o, s2, o2 in zip(AXES, self.scales, self.offsets, scales, offsets, strict=True)}
        return replace(self, df=self.df.withColumns(new), scales=scales, offsets=offsets)

    def append(self, other: PointCloud) -> PointCloud:
        """Both clouds' points; the other's coordinates follow this one's scales."""
        if other.fmt != self.fmt:
            raise IncompatibleData(f"point formats {self.fmt} and {other.fmt}")
        if (other.scales, other.offsets) != (self.scales, self.offsets):
            other = other.rescaled(self.scales, self.offsets)
        return replace(self, df=self.df.unionByName(other.df))

    def split(self, name: str, path: str) -> None:
        """One folder a value of a dimension, written in one pass."""
        self.df.withColumn(name, self.column(name)).write.partitionBy(name).parquet(path)


def differences(a: PointCloud, b: PointCloud) -> DataFrame:
    """(point_idx, names): points at one index that differ, with the dimensions that do, or null where only one cloud has the index.

    Clouds of other formats or user dimensions differ as a whole and raise; nulls and NaN equal themselves.
    """
    names = [c for c in a.df.columns if c not in ("point_idx", "path")]
    if a.fmt != b.fmt or sorted(names) != sorted(c for c in b.df.columns if c not in ("point_idx", "path")):
        raise IncompatibleData("clouds of other dimensions")
    row = lambda c, k: c.df.select("point_idx", F.struct(*[F.col(n).alias(n) for n in names]).alias(k))
    both = row(a, "_a").join(row(b, "_b"), "point_idx", "full")
    odd = F.array_compact(F.array(*[F.when(~F.col(f"_a.{n}").eqNullSafe(F.col(f"_b.{n}")), F.lit(n)) for n in names]))
    return both.select("point_idx", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), odd).alias("names")).where(F.col("names").isNull() | (F.size("names") > 0))


def equal(a: PointCloud, b: PointCloud) -> bool:
    """Whether both clouds have the same points at the same indices, scales and offsets included."""
    return (tuple(a.scales), tuple(a.offsets)) == (tuple(b.scales), tuple(b.offsets)) and differences(a, b).isEmpty()


def between_indices(df: DataFrame, first: int, n: int) -> DataFrame:
    """n points from an index on; a negative n means all that follow."""
    cond = F.col("point_idx") >= first
    return df.where(cond if n < 0 else cond & (F.col("point_idx") < first + n))


def seek(pos: int, whence: int, total: int) -> int:
    """The index that a seek from the start (whence 0) or from the end (2) leads to; outside the points it raises."""
    if whence not in (0, 2):
        raise ValueError(f"whence {whence}: 0 or 2")
    at = pos + total if whence == 2 else pos
    if not 0 <= at <= total:
        raise IndexError(f"point {at} of {total}")
    return at


def sliced(df: DataFrame, start: int | None, stop: int | None, step: int = 1, total: int | None = None) -> DataFrame:
    """Points start, start + step, ... before stop; with the number of points, negative ends count from the end and are cut to it."""
    if step < 1:
        raise ValueError("points keep their order: a step is positive")
    if total is not None:
        start, stop, _ = slice(start, stop, step).indices(total)
    elif start is None or stop is None or min(start, stop) < 0:
        raise ValueError("open and negative ends need the number of points")
    return df.where((F.col("point_idx") >= start) & (F.col("point_idx") < stop) & ((F.col("point_idx") - start) % step == 0))


def taken(df: DataFrame, indices: list[int], total: int | None = None) -> DataFrame:
    """The points of a given list, in its order and as often as it names them; with the number of points, negative indices count from the end and one
    outside raises."""
    if total is not None:
        if bad := [i for i in indices if not -total <= i < total]:
            raise IndexError(f"point {bad[0]} of {total}")
        indices = [i % total for i in indices]
    want = df.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(indices)], "pos long, point_idx long")
    return df.join(F.broadcast(want) if len(indices) <= TAKEN else want, "point_idx")


def resized(df: DataFrame, n: int, total: int) -> DataFrame:
    """The first n points, or all of them and zero points up to n."""
    kept = df.where(F.col("point_idx") < n)
    if n <= total:
        return kept
    pad = df.sparkSession.range(total, n).select(F.col("id").alias("point_idx"), *[F.lit(0).cast(t).alias(c) for c, t in df.dtypes if c != "point_idx"])
    return kept.unionByName(pad)


def zeros_like(cloud: PointCloud) -> PointCloud:
    """As many points, all zero."""
    return replace(cloud, df=cloud.df.select(*[F.lit(0).cast(t).alias(n) if "array" not in t else F.transform(n, lambda x: x * 0).cast(t).alias(n) for n, t in cloud.df.dtypes]))


def zeros(spark: SparkSession, n: int, fmt: int = 3, version: str | None = None) -> PointCloud:
    """A new cloud of n zero points; version: the format's own by default."""
    version = version or dims.preferred_version(fmt)
    dims.check_version(version, fmt)
    cols = dims.point_schema(fmt, index=False).fields
    return PointCloud(spark.range(n).select(*[F.lit(0).cast(f.dataType).alias(f.name) for f in cols]), fmt, version=version)


def with_lost_dimensions(pairs: DataFrame) -> DataFrame:
    """Rows (from_format, to_format, ...) with the names that a conversion loses, joined by commas."""
    formats = pairs.sparkSession.createDataFrame([(f, dims.dimension_names(f)) for f in dims.FORMATS], "f int, names array<string>")
    old, new = (formats.select(F.col("f").alias(k), F.col("names").alias(n)) for k, n in (("from_format", "_old"), ("to_format", "_new")))
    lost = F.array_join(F.array_sort(F.array_except("_old", "_new")), ",").alias("lost")
    return pairs.join(F.broadcast(old), "from_format").join(F.broadcast(new), "to_format").select(*pairs.columns, lost)  # a row a format
