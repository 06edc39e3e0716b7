"""One query an operator, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .fixtures import ROOT_SIDE, duck, events, octree, points, stored_points, whole_source
from .functions import exprs
from .operators import cloud, spatial, stats, waveform
from .operators.cloud import PointCloud
from .sources import las, lasfile, lasformat, octreefile, onefile, scratch, wdp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_P_COLS = "X, Y, Z, intensity, bit_fields, raw_classification, scan_angle_rank, user_data, point_source_id, gps_time, red, green, blue"
_X = "(X * CAST(0.01 AS DOUBLE) + CAST(100 AS DOUBLE))"
_CLS, _RN = "(raw_classification & 31)", "(bit_fields & 7)"


def _add(name: str, sql: str, views: str = "P"):
    ORACLE_SQL[name] = duck(sql, *views)

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        return f

    return keep


def _p(name: str, sql: str):
    """A query over view P: f(cloud)."""

    def keep(f: Callable[[PointCloud], DataFrame]) -> None:
        _add(name, sql)(lambda s, d: f(points(s, d)))

    return keep


def _e(name: str, sql: str):
    """A query over view E: f(frame)."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> None:
        _add(name, sql, "E")(lambda s, d: f(events(s, d)))

    return keep


def _o(name: str, sql: str, views: str = "O"):
    def keep(f: Callable[[DataFrame], DataFrame]) -> None:
        _add(name, sql, views)(lambda s, d: f(octree(s, d)))

    return keep



# ------------------------------------------------------------------------------------- columns and comparisons

_p("scan_points", f"SELECT {_P_COLS} FROM P")(lambda c: c.df)
_p("scan_empty", f"SELECT {_P_COLS} FROM P WHERE 1 = 0")(lambda c: c.df.where(F.lit(False)))
_p("zeros", "SELECT 0 AS X, 0 AS Y, 0 AS Z, 0 AS intensity, CAST(0 AS DOUBLE) AS gps_time FROM P")(lambda c: cloud.zeros_like(c).df.select("X", "Y", "Z", "intensity", "gps_time"))
_p("project_dims", f"SELECT X, Y, intensity, {_CLS} AS classification FROM P")(lambda c: c.select("X", "Y", "intensity", "classification"))
_p("alias_project", f"SELECT {_RN} AS return_num, (bit_fields & 56) >> 3 AS num_returns, point_source_id AS pt_src_id, bit_fields AS flag_byte FROM P")(lambda c: c.select("return_num", "num_returns", "pt_src_id", "flag_byte"))
_p("selective_projection", f"SELECT X, Y, {_RN} AS return_number, {_CLS} AS classification, intensity FROM P")(lambda c: c.select("X", "Y", "return_number", "classification", "intensity"))
_BITS = ", ".join(f"({box} & {mask}) >> {exprs.low_bit(mask)} AS {n}" for n, (box, mask) in dims.OLD_BITS.items())
_p("unpack_bits", f"SELECT X, Y, {_BITS} FROM P")(lambda c: c.select("X", "Y", *dims.OLD_BITS))
_p("pack_bits", "SELECT X, Y, (raw_classification & 224) | (intensity % 32) AS raw_classification FROM P")(lambda c: c.df.select("X", "Y", exprs.pack(F.col("raw_classification"), 0x1F, F.col("intensity") % 32).alias("raw_classification")))
_p("scaled_xyz", f"SELECT {_X} AS x_s, Y * CAST(0.001 AS DOUBLE) + CAST(0 AS DOUBLE) AS y_s, Z * CAST(0.01 AS DOUBLE) + CAST(0 AS DOUBLE) AS z_s FROM P")(lambda c: c.df.select(*[c.column(a).alias(f"{a}_s") for a in "xyz"]))
_p("xyz_array", f"SELECT a[1] AS e0, a[2] AS e1, a[3] AS e2 FROM (SELECT [{_X}, Y * CAST(0.001 AS DOUBLE) + 0, Z * CAST(0.01 AS DOUBLE) + 0] AS a FROM P) AS q")(lambda c: c.df.select(F.array(*[c.column(a) for a in "xyz"]).alias("a")).select(*[F.col("a")[k].alias(f"e{k}") for k in range(3)]))
_p("unscale_assign", f"SELECT CAST(round_even(({_X} + CAST(0.125 AS DOUBLE) - CAST(100 AS DOUBLE)) / CAST(0.01 AS DOUBLE), 0) AS INT) AS X, Y FROM P")(lambda c: c.df.select(exprs.unscale(c.column("x") + F.lit(0.125), 0.01, 100.0).alias("X"), "Y"))
_p("assign_dims", "SELECT X, Y, CAST(intensity * 2 AS INT) AS intensity, 7 AS user_data FROM P")(lambda c: c.df.withColumns({"intensity": (F.col("intensity") * 2).cast("int"), "user_data": F.lit(7)}).select("X", "Y", "intensity", "user_data"))
_p("mask_filter", f"SELECT {_P_COLS} FROM P WHERE {_CLS} = 2 AND intensity > 25")(lambda c: c.filter((c.column("classification") == 2) & (F.col("intensity") > 25)).df)
_p("cmp_plain", "SELECT X, Y, intensity FROM P WHERE intensity >= 30")(lambda c: c.df.where(exprs.compare(F.col("intensity"), ">=", 30)).select("X", "Y", "intensity"))
_p("cmp_subfield", f"SELECT X, Y, {_CLS} AS classification FROM P WHERE {_CLS} <= 4")(lambda c: c.df.where(exprs.compare_subfield(F.col("raw_classification"), 0x1F, "<=", 4)).select("X", "Y", c.column("classification").alias("classification")))
_p("cmp_scaled_raw", "SELECT X, Y FROM P WHERE X >= 1001")(lambda c: c.df.where(exprs.compare_scaled_raw(F.col("X"), ">=", 110.0149, 0.01, 100.0)).select("X", "Y"))
_p("ground_points", f"SELECT X, Y, Z FROM P WHERE {_CLS} = 2")(lambda c: c.filter("classification == 2").df.select("X", "Y", "Z"))
_p("last_return", f"SELECT X, Y, Z FROM P WHERE {_RN} = (bit_fields & 56) >> 3")(lambda c: c.df.where(c.column("return_number") == c.column("number_of_returns")).select("X", "Y", "Z"))
_MASKS = sorted({m for b in (dims.OLD_BITS, dims.NEW_BITS) for _, m in b.values()})
_p("mask_bits", "SELECT DISTINCT v, CAST(bit_count((v & (-v)) - 1) AS INT) AS lsb, CAST(bit_count(v) AS INT) AS bits, " + ", ".join(f"CAST(bit_count(v & {m}) AS INT) AS m{m}" for m in _MASKS) + " FROM (SELECT bit_fields AS v FROM P UNION ALL SELECT raw_classification FROM P) AS q WHERE v > 0")(lambda c: c.df.select("bit_fields").union(c.df.select("raw_classification")).toDF("v").where("v > 0").distinct().select("v", exprs.lowest_bit(F.col("v")).alias("lsb"), exprs.popcount(F.col("v")).alias("bits"), *[exprs.popcount(F.col("v").bitwiseAND(F.lit(m))).alias(f"m{m}") for m in _MASKS]))
_e("format_flags", "SELECT b, CASE WHEN (b & 192) = 128 THEN 1 ELSE 0 END AS compressed, b & 63 AS plain, b | 128 AS marked FROM (SELECT DISTINCT CAST(point_idx % 256 AS INT) AS b FROM E) AS q")(lambda e: e.select((F.col("point_idx") % 256).cast("int").alias("b")).distinct().select("b", exprs.is_compressed_format(F.col("b")).alias("compressed"), exprs.plain_format(F.col("b")).alias("plain"), exprs.mark_compressed(F.col("b")).alias("marked")))
_e("encoding_flags", "SELECT g, " + ", ".join(f"CASE WHEN (g & {b}) <> 0 THEN 1 ELSE 0 END AS {n}" for n, b in exprs.ENCODING_BITS.items()) + " FROM (SELECT DISTINCT CAST(point_idx % 128 AS INT) AS g FROM E) AS q")(lambda e: e.select((F.col("point_idx") % 128).cast("int").alias("g")).distinct().select("g", *[exprs.encoding_flag(F.col("g"), n).alias(n) for n in exprs.ENCODING_BITS]))

# --------------------------------------------------------------------------------------------- filter language

for _name, _text, _where in (
    ("dsl_compare", "x > 1010.0", f"{_X} > CAST(1010.0 AS DOUBLE)"),
    ("dsl_in", "classification in [2, 3, 5]", f"{_CLS} IN (2, 3, 5)"),
    ("dsl_pdal_alias", "ReturnNumber == 2 and PointSourceId < 50", f"{_RN} = 2 AND point_source_id < 50"),
    ("dsl_right_assoc", "classification == 1 and return_number == 2 or intensity > 40", f"{_CLS} = 1 AND ({_RN} = 2 OR intensity > 40)"),
    ("dsl_not", "not classification == 1 and return_number == 2", f"NOT ({_CLS} = 1 AND {_RN} = 2)"),
    ("dsl_paren", "(classification == 1 or classification == 2) and x > 1010.0", f"({_CLS} = 1 OR {_CLS} = 2) AND {_X} > CAST(1010.0 AS DOUBLE)"),
):
    _p(_name, f"SELECT X, Y, Z, intensity FROM P WHERE {_where}")(lambda c, t=_text: c.filter(t).df.select("X", "Y", "Z", "intensity"))

# -------------------------------------------------------------------------------------------------- statistics

_p("returns_histogram", f"SELECT {_RN} AS return_number, COUNT(*) AS n FROM P WHERE {_RN} BETWEEN 1 AND 15 GROUP BY 1")(lambda c: stats.returns_histogram(c.column("return_number"), c.df))
_p("header_bounds", f"SELECT min(X) * CAST(0.01 AS DOUBLE) + 100 AS x_min, max(X) * CAST(0.01 AS DOUBLE) + 100 AS x_max, min(Y) * CAST(0.001 AS DOUBLE) AS y_min, max(Y) * CAST(0.001 AS DOUBLE) AS y_max, min(Z) * CAST(0.01 AS DOUBLE) AS z_min, max(Z) * CAST(0.01 AS DOUBLE) AS z_max FROM P")(stats.header_bounds)
_p("gps_range", "SELECT min(gps_time) AS gps_min, max(gps_time) AS gps_max FROM P")(lambda c: c.df.agg(F.min("gps_time").alias("gps_min"), F.max("gps_time").alias("gps_max")))
_p("point_count", "SELECT COUNT(*) AS n FROM P")(lambda c: c.df.agg(F.count(F.lit(1)).alias("n")))
_STAT = ("X", "Y", "Z", "intensity", "gps_time", "return_number", "classification", "red")
_STAT_SQL = {"return_number": _RN, "classification": _CLS}
_p("dim_stats", " UNION ALL ".join(f"SELECT '{n}' AS dim, CAST(min({_STAT_SQL.get(n, n)}) AS DOUBLE) AS lo, CAST(max({_STAT_SQL.get(n, n)}) AS DOUBLE) AS hi FROM P" for n in _STAT))(lambda c: stats.extremes(c.df, {n: c.column(n) for n in _STAT}))
_p("class_counts", f"SELECT {_CLS} AS classification, COUNT(*) AS n FROM P GROUP BY 1")(lambda c: stats.counts(c.df, c.column("classification"), "classification"))
_e("extra_dim_stats", "SELECT min(extra0) AS lo, max(extra0) AS hi FROM E")(lambda e: e.agg(F.min("extra0").alias("lo"), F.max("extra0").alias("hi")))
_e("nodata_stats", "SELECT min(nullif(extra0, -10000)) AS lo, max(nullif(extra0, -10000)) AS hi, COUNT(nullif(extra0, -10000)) AS n FROM E")(lambda e: e.select(stats.without(F.col("extra0"), -10000).alias("v")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")))
_p("query_share", "SELECT CAST(COUNT(*) FILTER (WHERE X BETWEEN 50000 AND 100000) AS DOUBLE) * 100 / COUNT(*) AS pct FROM P")(lambda c: c.df.agg((F.count_if(F.col("X").between(50000, 100000)).cast("double") * 100 / F.count(F.lit(1))).alias("pct")))
_p("intensity_histogram", "SELECT CAST(least(floor(CAST(intensity AS DOUBLE) / CAST(5 AS DOUBLE)), 9) AS INT) AS bin, COUNT(*) AS n FROM P WHERE intensity BETWEEN 0 AND 50 GROUP BY 1")(lambda c: stats.histogram(c.df, F.col("intensity"), 0.0, 50.0, 10))

# ------------------------------------------------------------------------------------------------ whole clouds

_p("add_extra_dim", "SELECT X, Y, CAST(0 AS INT) AS codes, CAST(0 AS DOUBLE) AS height FROM P")(lambda c: c.add_dims(dims.ExtraDim("codes", "u2"), dims.ExtraDim("height", "f8")).df.select("X", "Y", "codes", "height"))
_p("remove_extra_dim", f"SELECT {_P_COLS} FROM P")(lambda c: c.add_dims(dims.ExtraDim("codes", "u2")).remove_dims("codes").df)
_add("scaled_vector", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 2 + 10 AS s0, CAST(embedding[2] AS DOUBLE) * 3 + 20 AS s1, CAST(embedding[3] AS DOUBLE) * 4 + 30 AS s2 FROM embeddings", "")(lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", exprs.scaled_vector(F.slice("embedding", 1, 3), (2, 3, 4), (10, 20, 30)).alias("v")).select("vec_id", *[F.col("v")[k].alias(f"s{k}") for k in range(3)]))
_add("vector_element", "SELECT vec_id, embedding[1] AS e0, embedding[64] AS e63 FROM embeddings", "")(lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.get("embedding", F.lit(0)).alias("e0"), F.get("embedding", F.lit(63)).alias("e63")))
_p("dim_arithmetic", "SELECT X + Y AS a, X - Y AS b, intensity * 3 AS c, (intensity + 250) % 256 AS wrapped, CAST(floor(CAST(Z AS DOUBLE) / 7) AS BIGINT) AS q FROM P")(lambda c: c.df.select((F.col("X") + F.col("Y")).alias("a"), (F.col("X") - F.col("Y")).alias("b"), (F.col("intensity") * 3).alias("c"), exprs.wrap_unsigned(F.col("intensity") + 250, 8).alias("wrapped"), F.floor(F.col("Z").cast("double") / 7).cast("long").alias("q")))
_add("convert_format", f"SELECT X, Y, Z, intensity, {_RN} AS return_number, (raw_classification & 32) >> 5 AS synthetic, 0 AS overlap, 0 AS scanner_channel, {_CLS} AS classification, user_data, 0 AS scan_angle, point_source_id, gps_time, red FROM P")(lambda s, d: whole_source(stored_points(s, d).convert(7).df).select("X", "Y", "Z", "intensity", *[F.col(n).cast("int").alias(n) for n in ("return_number", "synthetic", "overlap", "scanner_channel", "classification", "user_data", "scan_angle")], "point_source_id", "gps_time", "red"))
_LOST = ", ".join(f"({a}, {b}, '{','.join(sorted(dims.lost_dimensions(a, b)))}')" for a in dims.FORMATS for b in dims.FORMATS)
_e("lost_dimensions", f"SELECT from_format, to_format, lost, COUNT(*) AS n FROM (SELECT CAST(point_idx % 11 AS INT) AS from_format, CAST(point_idx // 11 % 11 AS INT) AS to_format FROM E) AS q JOIN (VALUES {_LOST}) AS t(a, b, lost) ON a = from_format AND b = to_format GROUP BY 1, 2, 3")(lambda e: cloud.with_lost_dimensions(e.select((F.col("point_idx") % 11).cast("int").alias("from_format"), (F.floor(F.col("point_idx") / 11) % 11).cast("int").alias("to_format")).groupBy("from_format", "to_format").agg(F.count(F.lit(1)).alias("n"))).select("from_format", "to_format", "lost", "n"))
_RESCALE = [("X", 0.01, 100, 0.05, 20), ("Y", 0.001, 0, 0.01, -5), ("Z", 0.01, 0, 0.1, 7)]
_p("change_scaling", "SELECT " + ", ".join(f"CAST(round_even((({a} * CAST({s} AS DOUBLE) + CAST({o} AS DOUBLE)) - CAST({o2} AS DOUBLE)) / CAST({s2} AS DOUBLE), 0) AS INT) AS {a}" for a, s, o, s2, o2 in _RESCALE) + " FROM P")(lambda c: c.rescaled((0.05, 0.01, 0.1), (20.0, -5.0, 7.0)).df.select("X", "Y", "Z"))
_SECOND = ((0.02, 0.002, 0.02), (110.0, 1.0, 10.0))  # scales that hold all rows
_p("union_rescaled", "SELECT X, Y, Z FROM P UNION ALL SELECT " + ", ".join(f"CAST(round_even((({a} * CAST({s2} AS DOUBLE) + CAST({o2} AS DOUBLE)) - CAST({o} AS DOUBLE)) / CAST({s} AS DOUBLE), 0) AS INT) AS {a}" for a, s, o, s2, o2 in zip("XYZ", (0.01, 0.001, 0.01), (100, 0, 0), *_SECOND, strict=True)) + " FROM P")(lambda c: c.append(PointCloud(c.df, 3, *_SECOND)).df.select("X", "Y", "Z"))
_p("append_union", f"SELECT {_P_COLS} FROM P WHERE {_CLS} = 2 UNION ALL SELECT {_P_COLS} FROM P WHERE {_CLS} <> 2")(lambda c: c.filter("classification == 2").append(c.filter("classification != 2")).df)


@_add("split_by_class", f"SELECT {_CLS} AS classification, X, Y, Z FROM P", "P")
def _split(s: SparkSession, d: str) -> DataFrame:
    c = points(s, d)
    path = scratch.folder(s, "split")
    PointCloud(c.select("X", "Y", "Z", "classification"), c.fmt, c.scales, c.offsets).split("classification", path)
    return s.read.parquet(path).select(F.col("classification").cast("int").alias("classification"), "X", "Y", "Z")


_add("resize_pad", "SELECT point_idx, X, Y FROM E UNION ALL SELECT CAST(range AS BIGINT), 0, 0 FROM range(COALESCE((SELECT max(point_idx) + 1 FROM E), 0), COALESCE((SELECT max(point_idx) + 1 FROM E), 0) + 500)", "E")(lambda s, d: (lambda e, n: cloud.resized(e.select("point_idx", "X", "Y"), n + 500, n))(events(s, d), events(s, d).agg(F.coalesce(F.max("point_idx") + 1, F.lit(0))).first()[0]))
_p("chunk_modify", f"SELECT X, Y, CASE WHEN {_CLS} = 2 THEN (raw_classification & 224) | 6 ELSE raw_classification END AS raw_classification FROM P")(lambda c: c.df.select("X", "Y", F.when(c.column("classification") == 2, exprs.pack(F.col("raw_classification"), 0x1F, F.lit(6))).otherwise(F.col("raw_classification")).alias("raw_classification")))


@_add("write_roundtrip", f"SELECT X, Y, Z, intensity, {_RN} AS return_number, {_CLS} AS classification, scan_angle_rank, user_data, point_source_id, gps_time, red, green, blue FROM P", "P")
def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(s, "las")
    las.write(stored_points(s, d).unpacked(), path)
    back = whole_source(las.load(s, path).df)
    names = ("X", "Y", "Z", "intensity", "return_number", "classification", "scan_angle_rank", "user_data", "point_source_id", "gps_time", "red", "green", "blue")
    return back.select(*[F.col(n).cast("double" if n == "gps_time" else "int").alias(n) for n in names])


# -------------------------------------------------------------------------------------------------- positional

_E_COLS = "point_idx, X, Y, Z"
_e("read_points", f"SELECT {_E_COLS} FROM E WHERE point_idx >= 100 AND point_idx < 350")(lambda e: cloud.between_indices(e, 100, 250).select("point_idx", "X", "Y", "Z"))
_e("seek_range", f"SELECT {_E_COLS} FROM E WHERE point_idx >= 700")(lambda e: cloud.between_indices(e, 700, -1).select("point_idx", "X", "Y", "Z"))
_e("chunk_ids", "SELECT CAST(floor(point_idx / CAST(64 AS DOUBLE)) AS BIGINT) AS chunk, COUNT(*) AS n, min(point_idx) AS first_idx FROM E GROUP BY 1")(lambda e: e.groupBy(F.floor(F.col("point_idx") / F.lit(64.0)).cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("point_idx").alias("first_idx")))
_e("slice_points", f"SELECT {_E_COLS} FROM E WHERE point_idx >= 10 AND point_idx < 500 AND (point_idx - 10) % 7 = 0")(lambda e: cloud.sliced(e, 10, 500, 7).select("point_idx", "X", "Y", "Z"))
_e("take_points", f"SELECT pos, {_E_COLS} FROM E JOIN (VALUES (CAST(0 AS BIGINT), 5), (1, 3), (2, 3), (3, 400)) AS t(pos, i) ON i = point_idx")(lambda e: cloud.taken(e, [5, 3, 3, 400]).select("pos", "point_idx", "X", "Y", "Z"))
_e("head_points", f"SELECT {_E_COLS} FROM E ORDER BY point_idx LIMIT 25")(lambda e: e.select("point_idx", "X", "Y", "Z").orderBy("point_idx").limit(25))

# ---------------------------------------------------------------------------------------------- spatial, octree

_p("box_2d", "SELECT X, Y, Z FROM P WHERE X BETWEEN 5000 AND 60000 AND Y BETWEEN 10000 AND 50000")(lambda c: spatial.box(c, (150.0, 10.0), (700.0, 50.0)).df.select("X", "Y", "Z"))
_p("box_3d", "SELECT X, Y, Z FROM P WHERE X BETWEEN 5000 AND 60000 AND Y BETWEEN 10000 AND 50000 AND Z BETWEEN 100000 AND 3000000")(lambda c: spatial.box(c, (150.0, 10.0, 1000.0), (700.0, 50.0, 30000.0)).df.select("X", "Y", "Z"))


@_add("bbox_outliers", "SELECT p.X, p.Y, p.Z FROM P p, (SELECT min(X) + 100 AS xl, max(X) - 100 AS xh, min(Z) + 50000 AS zl, max(Z) - 50000 AS zh FROM P) h WHERE p.X < xl OR p.X > xh OR p.Z < zl OR p.Z > zh", "P")
def _outliers(s: SparkSession, d: str) -> DataFrame:
    c = points(s, d)
    h = c.df.agg((F.min("X") + 100).alias("xl"), (F.max("X") - 100).alias("xh"), (F.min("Z") + 50000).alias("zl"), (F.max("Z") - 50000).alias("zh"))
    return c.df.join(F.broadcast(h), F.expr("X < xl OR X > xh OR Z < zl OR Z > zh")).select("X", "Y", "Z")  # one row is broadcast


_p("radius_filter", "SELECT X, Y FROM P WHERE sqrt((X - CAST(50000 AS DOUBLE)) * (X - CAST(50000 AS DOUBLE)) + (Y - CAST(30000 AS DOUBLE)) * (Y - CAST(30000 AS DOUBLE))) < CAST(15000 AS DOUBLE)")(lambda c: c.df.where(spatial.distance({"X": 50000, "Y": 30000}) < 15000.0).select("X", "Y"))
_cells = "CASE WHEN {a} % 25000 = 0 THEN [CAST({a} // 25000 AS INT) - 1, CAST({a} // 25000 AS INT)] ELSE [CAST({a} // 25000 AS INT)] END"
_p("tile_join", f"SELECT X, Y, tx, unnest({_cells.format(a='Y')}) AS ty FROM (SELECT X, Y, unnest({_cells.format(a='X')}) AS tx FROM P) AS q")(lambda c: spatial.tiles_inclusive(c.df, 25000).select("X", "Y", "tx", "ty"))
_p("tile_counts", "SELECT CAST(floor(X / CAST(25000 AS DOUBLE)) AS INT) AS tx, CAST(floor(Y / CAST(25000 AS DOUBLE)) AS INT) AS ty, COUNT(*) AS n FROM P GROUP BY 1, 2")(lambda c: c.df.select(*[t.alias(n) for t, n in zip(spatial.tile_of(25000), ("tx", "ty"), strict=True)]).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")))
_KNN = "(a.gps_time - b.gps_time) * (a.gps_time - b.gps_time) + (CAST(a.Z AS DOUBLE) - b.Z) * (CAST(a.Z AS DOUBLE) - b.Z)"


@_add("knn_k5", f'SELECT query, id, "rank", d2 FROM (SELECT a.point_idx AS query, b.point_idx AS id, {_KNN} AS d2, CAST(row_number() OVER (PARTITION BY a.point_idx ORDER BY {_KNN}, b.point_idx) AS INT) AS "rank" FROM E a JOIN E b ON a.point_idx <> b.point_idx WHERE a.point_idx % 50 = 0) AS q WHERE "rank" <= 5', "E")
def _knn(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select(F.col("point_idx").alias("id"), F.col("gps_time").alias("x"), F.col("Z").cast("double").alias("y"))
    return spatial.nearest(e, e.where("id % 50 = 0").withColumnRenamed("id", "query"), 5)


_e("topk_nearest", "SELECT point_idx, sqrt((X - CAST(30000 AS DOUBLE)) * (X - CAST(30000 AS DOUBLE)) + (Y - CAST(5000 AS DOUBLE)) * (Y - CAST(5000 AS DOUBLE))) AS d FROM E ORDER BY d, point_idx LIMIT 5")(lambda e: e.select("point_idx", spatial.distance({"X": 30000, "Y": 5000}).alias("d")).orderBy("d", "point_idx").limit(5))
_o("voxel_counts", "SELECT level, vx, vy, vz, point_count FROM O")(lambda o: o)
_o("octree_index", "SELECT level, COUNT(*) AS nodes, CAST(sum(point_count) AS BIGINT) AS points FROM O GROUP BY 1")(lambda o: o.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("point_count").alias("points")))
_o("voxel_children", "SELECT CAST(level + 1 AS INT) AS level, CAST(vx * 2 + (k & 1) AS INT) AS vx, CAST(vy * 2 + ((k >> 1) & 1) AS INT) AS vy, CAST(vz * 2 + ((k >> 2) & 1) AS INT) AS vz FROM O, range(8) AS r(k)")(lambda o: spatial.children(o))
_SIDE = "(CAST(2097152 AS DOUBLE) / power(CAST(2 AS DOUBLE), CAST(level AS DOUBLE)))"
_o("voxel_bounds", "SELECT level, vx, vy, vz, " + ", ".join(f"v{a} * {_SIDE} AS {a}_min, (v{a} + 1) * {_SIDE} AS {a}_max" for a in "xyz") + " FROM O")(lambda o: spatial.node_bounds(o, ROOT_SIDE))
_e("resolution_levels", "SELECT r AS resolution, CAST(1 + len(list_filter(range(0, 63), lambda k: CAST(100 AS DOUBLE) / power(CAST(2 AS DOUBLE), k) > r)) AS INT) AS levels, COUNT(*) AS n FROM (SELECT CAST(point_idx % 997 + 1 AS DOUBLE) / 8 AS r FROM E) AS q GROUP BY 1, 2")(lambda e: e.select(((F.col("point_idx") % 997 + 1).cast("double") / 8).alias("resolution")).groupBy("resolution").agg(F.count(F.lit(1)).alias("n")).select("resolution", spatial.levels_needed(100.0, F.col("resolution")).alias("levels"), "n"))
_BOX = ((0.0, 0.0, 0.0), (150000.0, 90000.0, 600000.0))
_HIT = " AND ".join(f"v{a} * {_SIDE} <= {hi} AND (v{a} + 1) * {_SIDE} >= {lo}" for a, lo, hi in zip("xyz", *_BOX, strict=True))
_REACH = f"(WITH RECURSIVE r AS (SELECT * FROM O WHERE level = 0 AND {_HIT} UNION ALL SELECT c.* FROM r JOIN (SELECT * FROM O WHERE {_HIT}) c ON c.level = r.level + 1 AND c.vx >> 1 = r.vx AND c.vy >> 1 = r.vy AND c.vz >> 1 = r.vz) SELECT * FROM r)"
_o("octree_prune", f"SELECT level, vx, vy, vz, point_count FROM {_REACH} AS q WHERE level <= 6")(lambda o: spatial.reachable(o, ROOT_SIDE, *_BOX, range(0, 7)))
_o("level_query", f"SELECT level, vx, vy, vz, point_count FROM {_REACH} AS q WHERE level BETWEEN 2 AND 4")(lambda o: spatial.reachable(o, ROOT_SIDE, *_BOX, range(2, 5)))


@_add("copc_query", f"SELECT X, Y, Z, p.level FROM (SELECT X, Y, Z, CAST(floor(Z / CAST(8 AS DOUBLE)) AS INT) AS Zq, CAST({_CLS} - 1 AS INT) AS level FROM P) p JOIN {_REACH} r ON r.level = p.level AND r.vx = CAST(floor(X / (CAST(2097152 AS DOUBLE) / power(2, p.level))) AS INT) AND r.vy = CAST(floor(Y / (CAST(2097152 AS DOUBLE) / power(2, p.level))) AS INT) AND r.vz = CAST(floor(Zq / (CAST(2097152 AS DOUBLE) / power(2, p.level))) AS INT) WHERE p.level < 5 AND X BETWEEN 0 AND 150000 AND Y BETWEEN 0 AND 90000 AND Zq BETWEEN 0 AND 600000", "O")
def _copc(s: SparkSession, d: str) -> DataFrame:
    c = points(s, d)
    level, zq = (c.column("classification") - 1).cast("int"), F.floor(F.col("Z") / F.lit(8.0)).cast("int")
    exact = (level < 5) & F.col("X").between(0, 150000) & F.col("Y").between(0, 90000) & zq.between(0, 600000)
    p = c.df.where(exact).select("X", "Y", "Z", level.alias("level"), *spatial.voxel(level, F.col("X"), F.col("Y"), zq, ROOT_SIDE))
    return p.join(spatial.reachable(octree(s, d), ROOT_SIDE, *_BOX, range(0, 5)).select("level", "vx", "vy", "vz"), ["level", "vx", "vy", "vz"], "left_semi").select("X", "Y", "Z", "level")


def _stored(o: DataFrame) -> DataFrame:
    """View L: the nodes' byte ranges, with every seventh taken out, so that there are gaps."""
    return spatial.with_layout(o).where(F.col("number") % 7 != 0).drop("number")


_o("nodes_by_offset", 'SELECT level, vx, vy, vz, point_count, byte_size, "offset" FROM L ORDER BY "offset"', "L")(lambda o: _stored(o).orderBy("offset"))


@_add("contiguous_groups", 'SELECT grp, min("offset") AS first_byte, CAST(sum(byte_size) AS BIGINT) AS n_bytes, COUNT(*) AS nodes FROM (SELECT *, CAST(sum(CASE WHEN pe = "offset" THEN 0 ELSE 1 END) OVER (ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM (SELECT *, lag("offset" + byte_size) OVER (ORDER BY "offset") AS pe FROM L) AS a) AS b GROUP BY 1', "L")
def _groups(s: SparkSession, d: str) -> DataFrame:
    return spatial.contiguous(_stored(octree(s, d)))


@_add("octree_table_query", ORACLE_SQL["copc_query"], "")
def _table_query(s: SparkSession, d: str) -> DataFrame:
    """The box query over points that were written as an octree table."""
    c, path = points(s, d), scratch.folder(s, "octree")
    level, zq = (c.column("classification") - 1).cast("int"), F.floor(F.col("Z") / F.lit(8.0)).cast("int")
    spatial.write_octree(c.df.select("X", "Y", "Z", "raw_classification"), level, (F.col("X"), F.col("Y"), zq), ROOT_SIDE, path)
    exact = F.col("X").between(0, 150000) & F.col("Y").between(0, 90000) & zq.between(0, 600000)
    return spatial.query_octree(s, path, ROOT_SIDE, *_BOX, range(0, 5)).where(exact).select("X", "Y", "Z", F.col("level").cast("int").alias("level"))


# --------------------------------------------------------------------------------------------------- waveforms

_PK = "CAST(floor(wavepacket_offset / CAST(wavepacket_size AS DOUBLE)) AS BIGINT)"
_e("has_waveform", "SELECT point_idx, wavepacket_index FROM E WHERE wavepacket_index <> 0")(lambda e: e.where("wavepacket_index <> 0").select("point_idx", "wavepacket_index"))
_add("waveform_gather", f"SELECT point_idx, COALESCE(embedding[1], CAST(0 AS FLOAT)) AS s0, COALESCE(embedding[64], CAST(0 AS FLOAT)) AS s63 FROM E LEFT JOIN embeddings ON wavepacket_index <> 0 AND vec_id = {_PK}", "E")(lambda s, d: waveform.gather(events(s, d), s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("packet"), F.col("embedding").alias("waveform")), 64).select("point_idx", F.col("waveform")[0].alias("s0"), F.col("waveform")[63].alias("s63")))
_add("missing_descriptors", "SELECT DISTINCT wavepacket_index FROM E WHERE wavepacket_index <> 0 AND wavepacket_index + 99 NOT IN (100, 101, 102, 103, 104)", "E")(lambda s, d: waveform.missing_descriptors(events(s, d), s.createDataFrame([(k,) for k in range(100, 105)], "record_id int")))
_e("waveform_dedup", f"SELECT packet, row_number() OVER (ORDER BY packet) - 1 AS new_index FROM (SELECT DISTINCT {_PK} AS packet FROM E WHERE wavepacket_index <> 0) AS q")(waveform.numbered)
_e("packet_runs", "SELECT min(v) AS first, max(v) AS last FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT CAST(Y AS BIGINT) AS v FROM E WHERE wavepacket_index <> 0) AS a) AS b GROUP BY g")(lambda e: waveform.runs(e.where("wavepacket_index <> 0").select(F.col("Y").cast("long").alias("v")).distinct(), "v"))
_e("waveform_repack", f"SELECT point_idx, wavepacket_index, CAST(COALESCE(n * wavepacket_size, 0) AS BIGINT) AS wavepacket_offset FROM E LEFT JOIN (SELECT packet, row_number() OVER (ORDER BY packet) - 1 AS n FROM (SELECT DISTINCT {_PK} AS packet FROM E WHERE wavepacket_index <> 0) AS a) AS b ON wavepacket_index <> 0 AND packet = {_PK}")(lambda e: waveform.repacked(e).select("point_idx", "wavepacket_index", "wavepacket_offset"))

# ---------------------------------------------------------------------------------------------------- metadata

_add("class_lookup", f"SELECT p.classification, COALESCE(substr(n_name, 1, 15), '') AS label, n FROM (SELECT {_CLS} AS classification, COUNT(*) AS n FROM P GROUP BY 1) p LEFT JOIN nation ON n_nationkey = classification", "P")(lambda s, d: (lambda c: stats.counts(c.df, c.column("classification"), "classification").join(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("classification"), F.substring("n_name", 1, 15).alias("label")), "classification", "left").select("classification", F.coalesce("label", F.lit("")).alias("label"), "n"))(points(s, d)))
_add("class_label_clean", "SELECT n_nationkey, substr(regexp_replace(n_name || '_#' || n_nationkey, '[^A-Za-z0-9 ]', '', 'g'), 1, 15) AS label FROM nation", "")(lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", exprs.class_label(F.concat("n_name", F.lit("_#"), F.col("n_nationkey").cast("string"))).alias("label")))


@_add("vlr_lookup", "SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'LASF_Spec' ELSE 'LASF_Projection' END AS user_id, CAST(n_nationkey * 7 AS INT) AS record_id, n_name AS description, n_regionkey >= 3 AS late FROM nation WHERE n_regionkey % 2 = 0 AND n_nationkey * 7 BETWEEN 0 AND 99", "")
def _vlrs(s: SparkSession, d: str) -> DataFrame:
    """Records made of the nations, written to files, some of them as extended ones, and looked up by user and range of ids."""
    path = scratch.folder(s, "vlrs")
    rows = s.read.parquet(f"{d}/nation.parquet").limit(1 << 15).collect()  # a header is made on the driver; so many records it holds at most
    records = [lasfile.Record("LASF_Spec" if r.n_regionkey % 2 == 0 else "LASF_Projection", r.n_nationkey * 7, r.n_name, r.n_name.encode(), r.n_regionkey >= 3) for r in rows]
    las.write(PointCloud(s.createDataFrame([], "X int, Y int, Z int"), 6, version="1.4"), path, records)
    return las.vlrs(s, path).where("user_id = 'LASF_Spec' AND record_id BETWEEN 0 AND 99").select("user_id", "record_id", "description", "late")


@_add("file_filter_convert", f"SELECT X, Y, Z, intensity, {_RN} AS return_number, {_CLS} AS classification, gps_time, red FROM P WHERE {_CLS} IN (2, 3) AND intensity > 20", "P")
def _file_filter(s: SparkSession, d: str) -> DataFrame:
    """File -> cloud -> filter -> another format -> file -> points."""
    one, two = scratch.folder(s, "las"), scratch.folder(s, "las")
    las.write(stored_points(s, d).unpacked(), one)
    las.write(las.load(s, one).filter("classification in [2, 3] and intensity > 20").convert(7), two)
    back = las.load(s, two).df
    return back.select(*[F.col(n).cast("double" if n == "gps_time" else "int").alias(n) for n in ("X", "Y", "Z", "intensity", "return_number", "classification", "gps_time", "red")])


_p("recursive_tiles", "SELECT * FROM (WITH RECURSIVE t AS (SELECT X, Y, 0 AS lv, CAST(floor(X / CAST(2097152 AS DOUBLE)) AS BIGINT) AS tx, CAST(floor(Y / CAST(2097152 AS DOUBLE)) AS BIGINT) AS ty, COUNT(*) OVER (PARTITION BY floor(X / CAST(2097152 AS DOUBLE)), floor(Y / CAST(2097152 AS DOUBLE))) AS n FROM P UNION ALL SELECT X, Y, lv + 1, CAST(floor(X / s) AS BIGINT), CAST(floor(Y / s) AS BIGINT), COUNT(*) OVER (PARTITION BY floor(X / s), floor(Y / s)) FROM (SELECT *, CAST(2097152 AS DOUBLE) / power(2, lv + 1) AS s FROM t WHERE n > 2000 AND lv < 8) AS q) SELECT lv AS t_level, tx, ty, COUNT(*) AS points FROM t WHERE n <= 2000 OR lv = 8 GROUP BY 1, 2, 3) AS z")(lambda c: spatial.recursive_tiles(c.df, 2000, 2097152.0, 8).groupBy("t_level", "tx", "ty").agg(F.count(F.lit(1)).alias("points")))
_e("set_encoding_flags", "SELECT DISTINCT CAST(point_idx % 128 AS INT) AS g, CAST(point_idx % 128 AS INT) | 65 AS with_offset, CAST(point_idx % 128 AS INT) & 65519 AS no_wkt FROM E")(lambda e: e.select((F.col("point_idx") % 128).cast("int").alias("g")).distinct().select("g", exprs.set_encoding_flag(F.col("g"), "gps_offset").alias("with_offset"), exprs.set_encoding_flag(F.col("g"), "wkt", False).alias("no_wkt")))
_e("doy_date", "SELECT y, dy, CASE WHEN dy >= 1 AND year(make_date(y, 1, 1) + (dy - 1)) = y THEN strftime(make_date(y, 1, 1) + (dy - 1), '%Y-%m-%d') ELSE '' END AS created FROM (SELECT DISTINCT CAST(2000 + point_idx % 25 AS INT) AS y, CAST(point_idx % 370 AS INT) AS dy FROM E) AS q")(lambda e: e.select((2000 + F.col("point_idx") % 25).cast("int").alias("y"), (F.col("point_idx") % 370).cast("int").alias("dy")).distinct().select("y", "dy", F.coalesce(F.date_format(exprs.doy_date(F.col("y"), F.col("dy")), "yyyy-MM-dd"), F.lit("")).alias("created")))
_add("c_string", "SELECT n_nationkey, split_part(n_name || chr(0) || 'rest', chr(0), 1) AS s FROM nation", "")(lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", exprs.c_string(F.concat("n_name", F.lit("\u0000rest"))).alias("s")))


# --------------------------------------------------------------------------------------------------- file formats


def _numbered_events(s: SparkSession, d: str) -> PointCloud:
    """E in order of its ids, with the id as a user dimension."""
    e = events(s, d).withColumn("event", F.col("point_idx")).orderBy("point_idx").drop("point_idx", "extra0")
    records = tuple(lasfile.pack_wave_descriptor(k, 16, 64, 1000) for k in range(1, 8))
    return PointCloud(e, 4, (0.001, 0.01, 1.0), version="1.3", extra=(dims.ExtraDim("event", "i8"),), records=records)


@_add("las_pushdown", "SELECT point_idx, X, Y, Z FROM (SELECT row_number() OVER (ORDER BY point_idx) - 1 AS point_idx, X, Y, Z FROM E) AS q WHERE point_idx >= 100 AND X BETWEEN 2000 AND 9000", "E")
def _pushdown(s: SparkSession, d: str) -> DataFrame:
    """One file, read by the las format with filters on an index and a coordinate that reach the source."""
    path = f"{scratch.folder(s, 'las')}/e.las"
    onefile.write_file(_numbered_events(s, d), path)
    return lasformat.table(s, path, "point_idx", "X", "Y", "Z").where("point_idx >= 100 AND X BETWEEN 2000 AND 9000").select("point_idx", "X", "Y", "Z")


@_add("one_file_append", f"SELECT X, Y, Z, intensity, gps_time FROM P UNION ALL SELECT {', '.join(f'CAST(round_even((({a} * CAST({s2} AS DOUBLE) + CAST({o2} AS DOUBLE)) - CAST({o} AS DOUBLE)) / CAST({sc} AS DOUBLE), 0) AS INT)' for a, sc, o, s2, o2 in zip('XYZ', (0.01, 0.001, 0.01), (100, 0, 0), *_SECOND, strict=True))}, intensity, gps_time FROM P WHERE {_CLS} = 2", "P")
def _one_file(s: SparkSession, d: str) -> DataFrame:
    """One file of all points, then ground points of other scales behind them, in the file."""
    c, path = stored_points(s, d).unpacked(), f"{scratch.folder(s, 'las')}/p.las"
    onefile.write_file(c, path)
    onefile.append_file(PointCloud(c.filter("classification == 2").df, 3, *_SECOND, extra=c.extra), path)
    return las.load(s, path).df.select("X", "Y", "Z", "intensity", "gps_time")


_SAMPLE = "CAST(floor((CAST(COALESCE(embedding[{}], -1) AS DOUBLE) + 1) * 1000) AS INT)"


@_add("payload_gather", f"SELECT event, wavepacket_offset, s0, s63 FROM (SELECT e.point_idx AS event, CAST(COALESCE(n * 128, 0) AS BIGINT) AS wavepacket_offset, CASE WHEN n IS NULL THEN 0 ELSE {_SAMPLE.format(1)} END AS s0, CASE WHEN n IS NULL THEN 0 ELSE {_SAMPLE.format(64)} END AS s63 FROM E e LEFT JOIN (SELECT packet, row_number() OVER (ORDER BY packet) - 1 AS n FROM (SELECT DISTINCT point_idx % 500 AS packet FROM E WHERE wavepacket_index <> 0) AS a) AS b ON wavepacket_index <> 0 AND packet = e.point_idx % 500 LEFT JOIN embeddings ON vec_id = packet) AS q", "E")
def _payload(s: SparkSession, d: str) -> DataFrame:
    """Events and embeddings, as samples of 16 bits, to a file and its payload, and back."""
    c, path = _numbered_events(s, d), f"{scratch.folder(s, 'las')}/e.las"
    df = c.df.withColumns({"wavepacket_offset": F.col("event") % 500 * 128, "wavepacket_size": F.lit(128).cast("long")})
    waves = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("packet"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 1000).cast("int")).alias("waveform"))
    wdp.write(replace(c, df=df), waves, path)
    return wdp.load(s, path).df.select("event", "wavepacket_offset", F.col("waveform")[0].alias("s0"), F.col("waveform")[63].alias("s63"))


_e("sampled_levels", "SELECT point_idx, CAST(min(lv) AS INT) AS level FROM (SELECT point_idx, lv, row_number() OVER (PARTITION BY lv, floor(X / (1048576 / power(2, lv) / 8)), floor(Y / (1048576 / power(2, lv) / 8)), floor(Z / (1048576 / power(2, lv) / 8)) ORDER BY point_idx * 7919 % 1000003, point_idx) AS rn FROM E, range(7) AS r(lv)) AS q WHERE rn = 1 OR lv = 6 GROUP BY 1")(lambda e: spatial.sampled_levels(e.select("point_idx", "X", "Y", "Z"), [F.col(a) for a in "XYZ"], 1048576.0, 6, 8, F.struct((F.col("point_idx") * 7919 % 1000003).alias("a"), "point_idx")).select("point_idx", "level"))


@_add("octree_file_query", "SELECT X, Y, Z, intensity FROM P WHERE X BETWEEN 5000 AND 90000 AND Y BETWEEN 1000 AND 50000 AND Z BETWEEN 100000 AND 3000000", "P")
def _octree_file(s: SparkSession, d: str) -> DataFrame:
    """An octree file of all points, whose pages and nodes under a box alone are read."""
    path = f"{scratch.folder(s, 'las')}/p.las"
    octreefile.write(stored_points(s, d).unpacked().convert(7), path, 6)
    return octreefile.query(s, path, (150.0, 1.0, 1000.0), (1000.0, 50.0, 30000.0), names=["intensity"]).df.select("X", "Y", "Z", "intensity")


@_add("extra_dim_record", " UNION ALL ".join(f"SELECT '{n}' AS name, {k} AS element, CAST(min({v}) AS DOUBLE) AS lo, CAST(max({v}) AS DOUBLE) AS hi FROM E" for n, k, v in (("extra0", 0, "nullif(extra0, -10000)"), ("v", 0, "point_idx % 100"), ("v", 1, "Y % 77"), ("v", 2, "nullif(Z, 5)"))), "E")
def _extremes(s: SparkSession, d: str) -> DataFrame:
    """Extremes of a scalar and of a vector dimension with no-data values, as the records of written files have them."""
    third = F.when(F.col("Z") == 5, -1).otherwise(F.col("Z"))
    e = events(s, d).withColumn("v", F.array(F.col("point_idx") % 100 + 0, F.col("Y") % 77, third).cast("array<int>"))
    user = (dims.ExtraDim("extra0", "i4", no_data=-10000), dims.ExtraDim("v", "i4", 3, no_data=-1))
    path = scratch.folder(s, "las")
    las.write(PointCloud(e.drop("point_idx"), 4, version="1.3", extra=user), path)
    return las.extra_dims(s, path).groupBy("name", "element").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
