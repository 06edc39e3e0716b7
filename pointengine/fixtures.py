"""Point views over the relational test tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .operators.cloud import PointCloud
from .operators.spatial import voxel

ROOT_SIDE = 2097152.0

_P = """SELECT CAST(l_partkey * 100 + l_linenumber AS INT) AS X, CAST(l_suppkey * 1000 + l_linenumber AS INT) AS Y,
 CAST({round}(l_extendedprice * CAST(100 AS DOUBLE){z}) AS INT) AS Z, CAST(l_quantity AS INT) AS intensity,
 CAST((1 + l_orderkey % 5) + 8 * 5 + 64 * (l_partkey % 2) + 128 * (l_suppkey % 2) AS INT) AS bit_fields,
 CAST(l_linenumber + 32 * (l_orderkey % 2) + 128 * (l_partkey % 2) AS INT) AS raw_classification,
 CAST(l_quantity - 25 AS INT) AS scan_angle_rank, CAST({round}(l_discount * CAST(100 AS DOUBLE){z}) AS INT) AS user_data,
 CAST(l_suppkey AS INT) AS point_source_id, l_extendedprice AS gps_time, CAST(l_partkey % 256 AS INT) AS red,
 CAST(l_suppkey % 256 AS INT) AS green, CAST(l_orderkey % 256 AS INT) AS blue FROM {t}"""
_E = """SELECT event_id AS point_idx, CAST(user_id * 1000 AS INT) AS X, CAST({round}(value * CAST(100 AS DOUBLE){z}) AS INT) AS Y,
 CAST(event_id % 97 AS INT) AS Z, value AS gps_time, CAST(event_id % 7 AS INT) AS wavepacket_index,
 CAST((event_id % 500) * 64 AS BIGINT) AS wavepacket_offset, CAST(64 AS BIGINT) AS wavepacket_size,
 CAST(CASE WHEN event_id % 11 = 0 THEN -10000 ELSE event_id % 1000 END AS INT) AS extra0 FROM {t}"""
_O = """SELECT level, CAST(floor(X / side) AS INT) AS vx, CAST(floor(Y / side) AS INT) AS vy, CAST(floor(Zq / side) AS INT) AS vz, COUNT(*) AS point_count
 FROM (SELECT X, Y, CAST(floor(Z / CAST(8 AS DOUBLE)) AS INT) AS Zq, CAST((raw_classification & 31) - 1 AS INT) AS level,
 CAST(2097152 AS DOUBLE) / power(CAST(2 AS DOUBLE), CAST((raw_classification & 31) - 1 AS DOUBLE)) AS side FROM P) AS q GROUP BY 1, 2, 3, 4"""
_L = """SELECT level, vx, vy, vz, point_count, byte_size, "offset" FROM (SELECT *, CAST(point_count * 20 AS BIGINT) AS byte_size,
 CAST(sum(point_count * 20) OVER w - point_count * 20 AS BIGINT) AS "offset", row_number() OVER w AS rn FROM O
 WINDOW w AS (ORDER BY level, vx, vy, vz ROWS UNBOUNDED PRECEDING)) AS q WHERE rn % 7 <> 0"""
_SQL = {"P": _P.format(round="round_even", z=", 0", t="lineitem"), "E": _E.format(round="round_even", z=", 0", t="events"), "O": _O, "L": _L}
_NEEDS = {"P": "", "E": "", "O": "P", "L": "PO"}

P_SCALES, P_OFFSETS = (0.01, 0.001, 0.01), (100.0, 0.0, 0.0)

#: What point_source_id has beyond the 16 bits that point formats give it: supplier keys of large tables need more.
SOURCE_HIGH = dims.ExtraDim("source_high", "u2")


def duck(sql: str, *views: str) -> str:
    """A DuckDB statement over the views it names."""
    need = [v for v in "PEOL" if v in views or any(v in _NEEDS[w] for w in views)]
    return f"WITH {', '.join(f'{v} AS ({_SQL[v]})' for v in need)} {sql}" if need else sql


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.format(round="rint", z="", t="{t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def points(spark: SparkSession, sf_dir: str) -> PointCloud:
    return PointCloud(_view(spark, sf_dir, _P, "lineitem"), 3, P_SCALES, P_OFFSETS)


def stored_points(spark: SparkSession, sf_dir: str) -> PointCloud:
    """The points as formats hold them, whatever the supplier keys: the high bits of point_source_id are a user dimension; whole_source() joins them."""
    c, own = points(spark, sf_dir), F.col("point_source_id")
    return replace(c, df=c.df.withColumns({"point_source_id": own.bitwiseAND(F.lit(0xFFFF)), SOURCE_HIGH.name: F.shiftrightunsigned(own, 16)}), extra=(*c.extra, SOURCE_HIGH))


def whole_source(df: DataFrame) -> DataFrame:
    """Points of stored_points() with point_source_id as the table has it."""
    return df.withColumn("point_source_id", F.col("point_source_id").cast("int").bitwiseOR(F.shiftleft(F.col(SOURCE_HIGH.name).cast("int"), 16)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _E, "events")


def octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points(spark, sf_dir)
    level = (c.column("classification") - 1).cast("int")
    z = F.floor(F.col("Z") / F.lit(8.0)).cast("int")
    return c.df.select(level.alias("level"), *voxel(level, F.col("X"), F.col("Y"), z, ROOT_SIDE)).groupBy("level", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("point_count"))
