"""LAS files with their headers and records, octree tables, tiles, ranks, arriving files."""

import random
import struct
import tracemalloc
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointengine import dims, queries
from pointengine.errors import CodecError, IncompatibleData
from pointengine.functions import exprs
from pointengine.operators import cloud, ranks, spatial, stats, waveform
from pointengine.operators.cloud import PointCloud
from pointengine.sources import las, lasfile, onefile
from pointengine.streaming import arriving

EXTRA = (dims.ExtraDim("height", "i4", scales=(0.5,), offsets=(10.0,)), dims.ExtraDim("v", "i2", 3, (1.0, 2.0, 3.0), (10.0, 20.0, 30.0)))


def points(spark, n=50, fmt=6):
    names = [d for d in dims.dimension_names(fmt) if d not in "XYZ"]
    return spark.range(n, numPartitions=2).select(F.col("id").cast("int").alias("X"), (F.col("id") * 2).cast("int").alias("Y"), F.col("id").cast("int").alias("Z"), *[(F.col("id") % 2).alias(d) for d in names])


def test_records_travel_with_the_cloud(spark, tmp_path):
    """Read -> filter -> convert -> write keeps scales, user dimensions, records and extended records."""
    own = (lasfile.Record("me", 7, "short", b"abc"), lasfile.Record("me", 42, "long", bytes(range(16)) * 5000, True), *lasfile.crs_records(6, wkt="LOCAL"))
    df = points(spark).withColumn("height", F.col("X")).withColumn("v", F.array(F.col("X"), F.col("X"), F.col("X")).cast("array<smallint>"))
    las.write(PointCloud(df, 6, (0.5, 0.25, 1.0), (1.0, 2.0, 3.0), "1.4", EXTRA, own), str(tmp_path / "a"))
    c = las.load(spark, str(tmp_path / "a"))
    assert (c.fmt, c.scales, c.offsets, c.version, c.extra) == (6, (0.5, 0.25, 1.0), (1.0, 2.0, 3.0), "1.4", EXTRA)
    assert {(r.user_id, r.record_id, r.data, r.extended) for r in c.records} == {(r.user_id, r.record_id, r.data, r.extended) for r in own}
    las.write(c.filter("X >= 40").convert(7), str(tmp_path / "b"))
    back = las.load(spark, str(tmp_path / "b"))
    assert back.fmt == 7 and {r.X for r in back.df.collect()} == set(range(40, 50)) and len(back.records) == 3
    assert sorted(r.height for r in back.select("height").collect()) == [x * 0.5 + 10 for x in range(40, 50)]
    assert sorted(map(tuple, (r.v for r in back.select("v").collect())))[0] == (50.0, 100.0, 150.0)
    found = {(r.user_id, r.record_id) for r in las.vlrs(spark, str(tmp_path / "b")).collect()}
    assert {("me", 7), ("me", 42), ("LASF_Projection", 2112), ("LASF_Spec", 4)} <= found


def test_scaled_dimensions_by_name(spark):
    c = PointCloud(spark.createDataFrame([(1, 2, 3, 4)], "X int, Y int, Z int, height int"), 0, extra=(EXTRA[0],))
    assert c.select("height").first().height == 12.0 and c.filter("height >= 12").df.count() == 1 and c.df.first().height == 4


def test_extended_records_need_a_new_version():
    late = lasfile.Record("me", 1, "", b"x", True)
    with pytest.raises(IncompatibleData):
        lasfile.Header(3, "1.2", records=[late]).pack()
    h = lasfile.Header(6, "1.4", records=[late, *lasfile.crs_records(6, wkt="W")])
    back = lasfile.Header.read(h.pack() + h.tail())
    assert [r.extended for r in back.records] == [False, True] and back.encoding & 16


def test_metadata_writers():
    r = lasfile.pack_class_lookup({2: "Ground", 6: "Building"})
    assert lasfile.parsed(r) == {2: "Ground", 6: "Building"}
    with pytest.raises(ValueError):
        lasfile.pack_class_lookup({300: "x"})
    w = lasfile.pack_wave_descriptor(1, 8, 64, 1000, 2.0, -1.0)
    assert w.record_id == 100 and lasfile.parsed(w) == {"bits": 8, "compression": 0, "samples": 64, "spacing": 1000, "gain": 2.0, "offset": -1.0}
    info = lasfile.parsed(lasfile.pack_copc_info((1.0, 2.0, 3.0), 4.0, 0.5, 100, 64, (7.0, 8.0)))
    assert info["center"] == (1.0, 2.0, 3.0) and info["root_offset"] == 100 and info["gps_max"] == 8.0
    page = lasfile.pack_hierarchy([(0, 0, 0, 0, 10, 20, 3), (1, 0, 1, 0, 30, 40, 5)])
    assert lasfile.parsed(page) == [(0, 0, 0, 0, 10, 20, 3), (1, 0, 1, 0, 30, 40, 5)]


def test_files_of_other_scales_and_boxes(spark, tmp_path):
    path = str(tmp_path / "x")
    for s in (1.0, 0.5):
        las.write(PointCloud(spark.createDataFrame([(10, 20, 30)], "X int, Y int, Z int").coalesce(1), 0, (s, s, s)), path)
    c = las.load(spark, path)
    first = c.scales[0]
    assert sorted(r.X * first for r in c.df.collect()) == [5.0, 10.0]
    assert las.read(spark, path, where=((0.0, 0.0, 0.0), (6.0, 99.0, 99.0))).count() == 1


@pytest.mark.parametrize("whole", [False, True])
def test_ranges_of_a_file(spark, tmp_path, monkeypatch, whole):
    """Files are read in ranges, whatever their number, or whole where only Spark reaches the store; one cut short gives what it has."""
    path = tmp_path / "a b"
    las.write(PointCloud(points(spark, 1000).coalesce(1), 6, version="1.4", records=(lasfile.Record("me", 1, "", bytes(70000), True), lasfile.Record("me", 2, "", bytes(60000)), lasfile.Record("me", 3, "", bytes(60000)))), str(path))
    monkeypatch.setattr(las, "RANGE_BYTES", 30 * 64)
    monkeypatch.setattr(las, "BATCH", 50)
    if whole:
        monkeypatch.setattr(las, "_store", lambda p: (_ for _ in ()).throw(OSError(p)))
    got = las.read(spark, str(path), names=["X", "Y"])
    assert sorted((r.point_idx, r.X, r.Y) for r in got.collect()) == [(i, i, 2 * i) for i in range(1000)]
    if not whole:
        assert got.rdd.getNumPartitions() > 10
    assert len(las.load(spark, str(path)).records) == 3 and las.headers(spark, str(path)).first().points == 1000
    one = next(path.glob("*.las"))
    raw = one.read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.las").write_bytes(raw[: lasfile.Header.points_at(raw) + 30 * 77 + 5])
    assert las.read(spark, str(tmp_path / "cut")).count() == 77


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bad = spark.range(4, numPartitions=2).select(F.col("id").cast("int").alias("X"), F.lit(0).alias("Y"), F.lit(0).alias("Z"), F.when(F.col("id") == 3, 99).otherwise(1).alias("return_number"))
    with pytest.raises(Exception, match="return_number"):
        las.write(PointCloud(bad, 0), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.las")) if (tmp_path / "bad").exists() else True


def test_a_task_holds_a_file_once(monkeypatch):
    """Points of a file are neither joined nor copied before they are written."""
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(las, "FILE_BYTES", 8 << 20)
    n = 10000
    made = (pa.RecordBatch.from_pydict({a: np.arange(n, dtype=np.int32) for a in "XYZ"}) for _ in range(3 * (8 << 20) // (20 * n)))
    tracemalloc.start()
    files = sum(1 for _ in las.encode_batches(made, {"fmt": 0}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert files == 3 and peak < 1.5 * (8 << 20)


def test_octree_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(1024), rng.randrange(1024), rng.randrange(1024), k % 5) for k in range(3000)]
    df = spark.createDataFrame(rows, "X int, Y int, Z int, lv int")
    spatial.write_octree(df, F.col("lv"), (F.col("X"), F.col("Y"), F.col("Z")), 1024.0, str(tmp_path / "o"))
    lo, hi = (100.0, 0.0, 300.0), (500.0, 200.0, 900.0)
    got = spatial.query_octree(spark, str(tmp_path / "o"), 1024.0, lo, hi, range(1, 4))
    nodes = {(lv, x >> (10 - lv), y >> (10 - lv), z >> (10 - lv)) for x, y, z, lv in rows}

    def reached(lv, *v):
        return all((lv - u, *(c >> u for c in v)) in nodes and hits(lv - u, *(c >> u for c in v)) for u in range(lv + 1))

    def hits(lv, *v):
        own = 1024 / 2**lv
        return all(c * own <= b and (c + 1) * own >= a for c, a, b in zip(v, lo, hi))

    want = sorted((x, y, z) for x, y, z, lv in rows if 1 <= lv < 4 and reached(lv, x >> (10 - lv), y >> (10 - lv), z >> (10 - lv)))
    assert sorted((r.X, r.Y, r.Z) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan
    fine = spatial.query_octree(spark, str(tmp_path / "o"), 1024.0, lo, hi, resolution=50.0, spacing=100.0)
    assert {r.level for r in fine.select("level").distinct().collect()} <= {0, 1}


def test_octree_table_over_much_ground(spark, tmp_path):
    """However far the points lie apart, and below the origin too, folders and files stay few; the box still opens only some of them."""
    rng = random.Random(5)
    rows = [(rng.randrange(-3000, 60000), rng.randrange(-3000, 60000), rng.randrange(2000), k % 5) for k in range(6000)] + [(7, 7, 7, 0), (None, 7, 7, 1)]
    df = spark.createDataFrame(rows, "X int, Y int, Z int, lv int")
    spatial.write_octree(df, F.col("lv"), (F.col("X"), F.col("Y"), F.col("Z")), 1024.0, str(tmp_path / "o"))
    folders = list((tmp_path / "o" / "points").rglob("cell=*"))
    assert 5 < len(folders) <= 257 and len(list((tmp_path / "o").rglob("*.parquet"))) < 512
    lo, hi = (-2000.0, -2000.0, 0.0), (9000.0, 9000.0, 900.0)
    got = spatial.query_octree(spark, str(tmp_path / "o"), 1024.0, lo, hi, range(0, 3))
    nodes = {(lv, *(int(v // (1024 / 2**lv)) for v in r)) for *r, lv in rows if r[0] is not None}
    hits = lambda lv, *v: all(c * 1024 / 2**lv <= b and (c + 1) * 1024 / 2**lv >= a for c, a, b in zip(v, lo, hi))
    reached = lambda lv, *v: all((lv - u, *(c >> u for c in v)) in nodes and hits(lv - u, *(c >> u for c in v)) for u in range(lv + 1))
    want = sorted((*r, lv) for *r, lv in rows if r[0] is not None and lv < 3 and reached(lv, *(int(v // (1024 / 2**lv)) for v in r)))
    assert sorted((r.X, r.Y, r.Z, r.lv) for r in got.collect()) == want and len({r[3] for r in want}) > 1

def test_tiles_are_split_until_small(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(64), rng.randrange(64)) for _ in range(300)] + [(5, 5)] * 40
    out = spatial.recursive_tiles(spark.createDataFrame(rows, "X int, Y int"), 20, 64.0, 4).collect()
    assert len(out) == len(rows)
    size = {}
    for r in out:
        side = 64 / 2**r.t_level
        assert r.tx == r.X // side and r.ty == r.Y // side
        size[r.t_level, r.tx, r.ty] = size.get((r.t_level, r.tx, r.ty), 0) + 1
    assert all(n <= 20 or lv == 4 for (lv, _, _), n in size.items()) and len({lv for lv, _, _ in size}) > 1


def test_tiles_of_scattered_points(spark):
    """A dense spot among points that lie far apart is cut deep; the others are not counted at its depth."""
    rng = random.Random(6)
    rows = [(rng.randrange(-9000, 9000), rng.randrange(-9000, 9000)) for _ in range(300)] + [(40 + k % 3, 900) for k in range(60)] + [(None, 1)]
    tiles = spatial.recursive_tiles(spark.createDataFrame(rows, "X int, Y int"), 20, 1024.0, 10)
    out, size, whole = tiles.collect(), {}, {}
    for x, y in rows[:-1]:
        for lv in range(11):
            key = (lv, x // (1024 >> lv), y // (1024 >> lv))
            whole[key] = whole.get(key, 0) + 1
    for r in out:
        assert all(whole[lv, r.X // (1024 >> lv), r.Y // (1024 >> lv)] > 20 for lv in range(r.t_level)) and (r.tx, r.ty) == (r.X // (1024 >> r.t_level), r.Y // (1024 >> r.t_level))
        size[r.t_level, r.tx, r.ty] = size.get((r.t_level, r.tx, r.ty), 0) + 1
    assert len(out) == len(rows) - 1 and max(lv for lv, _, _ in size) > 8 and all(n == whole[t] and (n <= 20 or t[0] == 10) for t, n in size.items())
    assert "sequence(0, 10" not in tiles._jdf.queryExecution().toString()


def test_nearest_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(1000)) if i % 9 else 1e6, float(rng.randrange(40))) for i in range(400)] + [(400 + i, 3.0, 3.0) for i in range(30)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    got = {}
    for r in spatial.nearest(p, p.where("id % 20 = 0").withColumnRenamed("id", "query"), 4, 2.0).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.d2))
    for q, x, y in rows:
        if q % 20 == 0:
            best = sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in rows if i != q)[:4]
            assert [(i, d) for _, i, d in sorted(got[q])] == [(i, d) for d, i in best]
    assert spatial.nearest(p.limit(0), p.withColumnRenamed("id", "query"), 3, 1.0).count() == 0


@pytest.mark.parametrize("k", [1, 3, 600])
def test_nearest_in_space(spark, k):
    """Three axes, clusters of very different density, a place that many points share, fewer points than are asked for."""
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for i in range(200)] + [(200 + i, rng.uniform(0, 1000), rng.uniform(0, 1000), rng.uniform(0, 10)) for i in range(200)] + [(400 + i, 7.0, 7.0, 7.0) for i in range(100)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    outside = [(10000 + 10 * i, x, y, z) for i, (x, y, z) in enumerate([(-1e5, 3.0, 3.0), (1001.0, 1001.0, 10.5), (-0.01, 0.0, 0.0), (500.0, 1e7, 5.0), (999.0, -3.0, 4.0)])]
    q = spark.createDataFrame([r for r in rows if r[0] % 10 == 0] + outside, "query long, x double, y double, z double")
    got = {}
    for r in spatial.nearest(p, q, k).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.d2))
    for q, x, y, z in rows + outside:
        if q % 10 == 0:
            best = sorted(((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z), i) for i, a, b, c in rows if i != q)[:k]
            assert [(i, d) for _, i, d in sorted(got[q])] == [(i, d) for d, i in best]


def test_ranks_and_runs(spark):
    v = [-5, -4, 0, 7, 8, 9, 10**12]
    df = spark.createDataFrame([(x,) for x in reversed(v)], "v long")
    assert {r.v: r.n for r in ranks.ranked(df, "v", "n").collect()} == {x: i for i, x in enumerate(v)}
    assert ranks.ranked(df.limit(0), "v", "n").count() == 0
    assert sorted(map(tuple, waveform.runs(df, "v").collect())) == [(-5, -4), (0, 0), (7, 9), (10**12, 10**12)]


def test_packet_checks(spark):
    p = lambda offsets: spark.createDataFrame([(1, o, 8) for o in offsets] + [(0, 3, 0)], "wavepacket_index int, wavepacket_offset long, wavepacket_size long")
    assert waveform.checked_offsets(p([12, 20]), 8).count() == 2
    with pytest.raises(ValueError, match="remainders"):
        waveform.checked_offsets(p([8, 13]), 8)
    with pytest.raises(ValueError, match="bytes"):
        waveform.checked_offsets(p([16]), 4)
    assert waveform.sample_kind(16) == "u2"
    with pytest.raises(ValueError):
        waveform.sample_kind(12)


def test_small_things(spark):
    assert spatial.parse_bounds("1,2,3,4") == ((1.0, 2.0), (3.0, 4.0)) and spatial.parse_bounds("[0 0 0 1 1 1]")[1] == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        spatial.parse_bounds("3,2,1")
    g = spark.range(1).select(exprs.set_encoding_flag(F.lit(0), "gps_offset").alias("a"), exprs.set_encoding_flag(F.lit(17), "wkt", False).alias("b")).first()
    assert (g.a, g.b) == (65, 1)
    e = spark.createDataFrame([(0, 4), (1, 5)], "point_idx long, X int")
    assert sorted(r.X for r in cloud.taken(e, [1, 1, 0]).collect()) == [4, 5, 5]
    one = cloud.resized(e.where("point_idx = 0"), 3, 1)
    assert sorted((r.point_idx, r.X) for r in one.collect()) == [(0, 4), (1, 0), (2, 0)]
    r = [x.v for x in spark.range(50).select(exprs.randomised(F.col("id"), F.lit(1), 7).alias("v")).collect()]
    assert all(0 <= x <= 7 for x in r) and len(set(r)) > 3
    c = PointCloud(spark.createDataFrame([(0, 0, 0, 3), (0, 0, 0, 0)], "X int, Y int, Z int, classification_flags int"), 6)
    assert c.filter("ClassFlags > 0").df.count() == 1


def test_arriving_files(spark, tmp_path):
    """Points of files that come, every file once; a batch that is run again, or that is empty, changes no figure."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    c = PointCloud(spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "X int, Y int, Z int"), 0, (1.0, 1.0, 1.0))
    las.write(c, path)
    seen = []
    for k in range(3):
        stream = arriving.points(spark, path, c, ["X", "Y", "Z"])
        arriving.header_figures(stream, out, str(tmp_path / "cp"), c).awaitTermination()
        seen.append(arriving.merged(spark, out).first())
        if k == 0:
            las.write(PointCloud(spark.createDataFrame([(9, 9, 9), (7, 7, -7)], "X int, Y int, Z int"), 0, (1.0, 1.0, 1.0)), path)
    points = spark.read.parquet(out)
    assert (seen[0].n, seen[0].x_min, seen[0].x_max) == (2, 1.0, 4.0)
    assert seen[1] == seen[2] and (seen[1].n, seen[1].x_min, seen[1].z_min, seen[1].z_max) == (4, 1.0, -7.0, 9.0)
    assert points.where("n = 0").count() == 0
    # the last batch, run once more, and one without points
    again = {}
    writer = type("W", (), {"__getattr__": lambda self, n: lambda *a, **k: again.update({n: a}) or self})()
    arriving.header_figures(type("D", (), {"writeStream": writer})(), out, "x", c)
    batch = again["foreachBatch"][0]
    batch(spark.createDataFrame([(9, 9, 9), (7, 7, -7)], "X int, Y int, Z int"), 1)
    batch(spark.createDataFrame([], "X int, Y int, Z int"), 7)
    assert arriving.merged(spark, out).first() == seen[2]


def test_extremes_of_user_dimensions(spark, tmp_path):
    """Element by element, no-data and NaN left out, in one aggregation; files keep them, also after an append."""
    user = (dims.ExtraDim("h", "i4", no_data=-9999), dims.ExtraDim("v", "i2", 3, (1.0,) * 3, (0.0,) * 3), dims.ExtraDim("f", "f8", 2), dims.ExtraDim("none", "u1", no_data=0), dims.ExtraDim("raw", "u1", 5))
    rows = [(k, k, k, -9999 if k % 3 == 0 else k - 50, [k, -k, 7], [float("nan") if k == 4 else k / 2, -1.5], 0, [1] * 5) for k in range(100)]
    df = spark.createDataFrame(rows, "X int, Y int, Z int, h int, v array<smallint>, f array<double>, none smallint, raw array<smallint>")
    c = PointCloud(df, 0, extra=user)
    r = stats.vector_extremes(df, user[:3]).first()
    assert (r.h__0__lo, r.h__0__hi, r.v__1__lo, r.v__2__hi, r.f__0__hi, r.f__1__lo) == (-49, 48, -99, 7, 49.5, -1.5)
    path = str(tmp_path / "x.las")
    onefile.write_file(c, path)
    known = {e.name: (e.mins, e.maxs) for e in las.load(spark, path).extra}
    assert known == {"h": ((-49,), (48,)), "v": ((0, -99, 7), (99, 0, 7)), "f": ((0.0, -1.5), (49.5, -1.5)), "none": (None, None), "raw": (None, None)}
    more = spark.createDataFrame([(1, 1, 1, 500, [-5, 0, 0], [0.0, 0.0], 3, [2] * 5)], df.schema)
    onefile.append_file(PointCloud(more, 0, extra=user), path)
    known = {e.name: (e.mins, e.maxs) for e in las.load(spark, path).extra}
    assert known["h"] == ((-49,), (500,)) and known["v"] == ((-5, -99, 0), (99, 0, 7)) and known["none"] == (None, None)
    las.write(c, str(tmp_path / "parts"))
    got = las.extra_dims(spark, str(tmp_path / "parts")).groupBy("name", "element").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    assert {(g.name, g.element): (g.lo, g.hi) for g in got}["v", 1] == (-99.0, 0.0)
    assert sorted(map(tuple, (r.v for r in las.load(spark, path).df.select("v").collect())))[0] == (-5, 0, 0)


def zip_codec(chunk):
    """A codec of chunks of zlib, with a plain table."""
    return lasfile.Codec(
        lasfile.Record("toy zip", 1, "chunks of zlib"),
        lambda raw, h: zlib.compress(raw),
        lambda raw, h, n: zlib.decompress(raw),
        lambda t: struct.pack("<I", len(t)) + b"".join(struct.pack("<II", *x) for x in t),
        lambda raw: [struct.unpack_from("<II", raw, 4 + 8 * k) for k in range(struct.unpack_from("<I", raw)[0])],
        chunk,
    )


def test_a_codec_of_chunks(spark, tmp_path, monkeypatch):
    """Written and read chunk by chunk; one file is read by several tasks, which read their chunks' bytes alone."""
    path = str(tmp_path / "z")
    late = lasfile.Record("me", 9, "late", bytes(500), True)
    c = PointCloud(points(spark, 1000).coalesce(1), 6, (0.5,) * 3, version="1.4", records=(late,))
    with pytest.raises(CodecError):
        las.write(c, path, codec="zip")
    monkeypatch.setitem(lasfile.CODECS, "zip", zip_codec(70))
    las.write(c, path, codec="zip")
    (one,) = (tmp_path / "z").glob("*.laz")
    raw = one.read_bytes()
    h = lasfile.Header.read(raw)
    assert h.compressed and h.count == 1000 and len(raw) < 1000 * h.record_size and [r.data for r in h.records if r.extended] == [bytes(500)]
    monkeypatch.setattr(las, "RANGE_BYTES", 900)
    back = las.load(spark, path)
    got = back.df.select("point_idx", "X", "Y", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.point_idx, r.X, r.Y) for r in got) == [(i, i, 2 * i) for i in range(1000)]
    ranges = las._listed(spark, path).mapInArrow(las._ranges(None, dict(lasfile.CODECS)), "path string, first long, n long").collect()
    assert len(ranges) > 3 and all(r.first % 70 == 0 for r in ranges) and sum(r.n for r in ranges) == 1000
    assert not [r for r in back.records if r.user_id == "toy zip"]
    las.write(back.filter("X < 10"), str(tmp_path / "plain"))
    assert las.load(spark, str(tmp_path / "plain")).df.count() == 10 and not las.headers(spark, str(tmp_path / "plain")).first().compressed
    las.write(c.filter("X < 0"), str(tmp_path / "none"), codec="zip")
    assert las.load(spark, str(tmp_path / "none")).df.count() == 0
    monkeypatch.delitem(lasfile.CODECS, "zip")
    with pytest.raises(Exception, match="no codec"):
        las.load(spark, path).df.collect()


def test_keys_wider_than_a_format(spark, tmp_path):
    """Supplier keys of a large table have more than the 16 bits of point_source_id: files hold them whole, and queries give all rows."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT * REPLACE (l_suppkey + CASE WHEN l_orderkey % 2 = 0 THEN 359000 ELSE 0 END AS l_suppkey) FROM '/root/testdata/sf0.001/lineitem.parquet'")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for name in ("octree_file_query", "write_roundtrip", "file_filter_convert", "one_file_append", "convert_format"):
        mine, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
        a, b = (x[sorted(want.columns)].sort_values(sorted(want.columns), ignore_index=True).values.tolist() for x in (mine, want))
        assert a == b and len(a)
