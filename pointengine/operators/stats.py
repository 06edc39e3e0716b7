"""Header statistics and per-dimension figures, as one aggregation each."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ExtraDim
from ..functions import exprs
from .cloud import AXES, PointCloud


def header_bounds(cloud: PointCloud) -> DataFrame:
    """One row x_min, x_max, ...: raw extremes, scaled afterwards; zeros for an empty cloud."""
    raw = cloud.df.agg(*[f(a).alias(f"{a}{n}") for a in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))])
    cols = []
    for a, s, o in zip(AXES, cloud.scales, cloud.offsets, strict=True):
        cols += [F.coalesce(exprs.scale(F.col(f"{a}{n}"), s, o), F.lit(0.0)).alias(f"{a.lower()}_{m}") for n, m in (("lo", "min"), ("hi", "max"))]
    return raw.select(*cols)


def returns_histogram(number: Column, df: DataFrame) -> DataFrame:
    """Points of each return from 1 to 15."""
    return df.where(number.between(1, 15)).groupBy(number.cast("int").alias("return_number")).agg(F.count(F.lit(1)).alias("n"))


def extremes(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """(dim, lo, hi) of many dimensions in one pass."""
    one = df.agg(*[f(c.cast("double")).alias(f"{n}__{k}") for n, c in cols.items() for f, k in ((F.min, "lo"), (F.max, "hi"))])
    rows = [F.struct(F.lit(n).alias("dim"), F.col(f"{n}__lo").alias("lo"), F.col(f"{n}__hi").alias("hi")) for n in cols]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def without(value: Column, no_data: Iterable[float] | float) -> Column:
    """The value, or null where it is the no-data value."""
    return F.nullif(value, F.lit(no_data))


def vector_extremes(df: DataFrame, dims_of: tuple[ExtraDim, ...]) -> DataFrame:
    """One row with name__k__lo and name__k__hi of every element of user dimensions, raw, no-data and NaN left out: one aggregation."""
    cols = []
    for e in dims_of:
        for k in range(e.count):
            v = F.get(e.name, F.lit(k)) if e.count > 1 else F.col(e.name)
            v = F.when(v != F.lit(e.no_data), v) if e.no_data is not None else v
            v = F.when(~F.isnan(v), v) if e.kind[0] == "f" else v
            cols += [F.min(v).alias(f"{e.name}__{k}__lo"), F.max(v).alias(f"{e.name}__{k}__hi")]
    return df.agg(*cols)


def extra_extremes(cloud: PointCloud) -> tuple[ExtraDim, ...]:
    """The cloud's user dimensions with their extremes; none where an element has no value, or for more than three elements."""
    few = tuple(e for e in cloud.extra if e.count <= 3 and e.name in cloud.df.columns)
    if not few:
        return cloud.extra
    r = vector_extremes(cloud.df, few).first()
    ends = {e.name: [tuple(r[f"{e.name}__{k}__{m}"] for k in range(e.count)) for m in ("lo", "hi")] for e in few}
    full = {n for n, (lo, _) in ends.items() if None not in lo}
    return tuple(replace(e, mins=ends[e.name][0] if e.name in full else None, maxs=ends[e.name][1] if e.name in full else None) for e in cloud.extra)


def counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins; the last one holds its upper end."""
    b = F.least(F.floor((value.cast("double") - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(value.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
