"""The las format with push-down, one file out of many tasks, append, waveform payloads."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointengine import dims
from pointengine.errors import IncompatibleData
from pointengine.operators import cloud
from pointengine.operators.cloud import PointCloud
from pointengine.sources import las, lasfile, lasformat, onefile, wdp

META = dims.FileMeta(encoding=1, source_id=77, guid=bytes(range(16)), system="scanner", software="some tool", created=dt.date(2020, 2, 29))


def points(spark, n=1000, fmt=6, parts=8, start=0):
    names = [d for d in dims.dimension_names(fmt) if d not in "XYZ"]
    return spark.range(start, start + n, numPartitions=parts).select(F.col("id").cast("int").alias("X"), (F.col("id") * 2).cast("int").alias("Y"), F.col("id").cast("int").alias("Z"), *[(F.col("id") % 2).alias(d) for d in names])


def test_pushed_filters(spark, tmp_path):
    """Files outside a box and ranges outside the indices get no partition; rows are what a plain filter gives."""
    path = str(tmp_path / "in")
    las.write(PointCloud(points(spark), 6, (1.0, 1.0, 1.0), version="1.4"), path)
    lasformat.register(spark)
    t = spark.read.format("las").option("range_bytes", 20 * 30).load(path)
    assert t.columns[:2] == ["path", "point_idx"] and t.count() == 1000
    every = t.rdd.getNumPartitions()
    box = t.where("X between 300 and 310").select("X", "Y")
    assert sorted(map(tuple, box.collect())) == [(x, 2 * x) for x in range(300, 311)]
    some = box.rdd.getNumPartitions()
    assert some <= every // 4
    one = t.where("X between 300 and 310 and point_idx < 30")
    assert one.rdd.getNumPartitions() < some
    assert sorted(r.point_idx for r in t.where("point_idx in (7, 9)").select("point_idx").collect()) == sorted([7, 9] * len({r.path for r in t.select("path").distinct().collect()}))
    assert t.where("X > 5000").count() == 0 == t.where("Z = -1").count()
    few = spark.read.format("las").schema("Y int, intensity int").load(path)
    assert few.columns == ["Y", "intensity"] and few.agg(F.sum("Y")).first()[0] == 999 * 1000
    assert lasformat.table(spark, path, "X", "gps_time").columns == ["path", "X", "gps_time"]
    with pytest.raises(Exception, match="no nir"):
        spark.read.format("las").schema("nir int").load(path).count()
    with pytest.raises(Exception, match="no LAS file"):
        lasformat.table(spark, str(tmp_path / "nothing"))


def test_format_in_sql_and_writing(spark, tmp_path):
    lasformat.register(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = points(spark, 100, 3, 4)
    df.write.format("las").option("point_format", 3).option("scales", "0.5,0.5,1").mode("append").save(a)
    assert las.load(spark, a).scales == (0.5, 0.5, 1.0) and las.headers(spark, a).agg(F.sum("points")).first()[0] == 100
    df.limit(7).write.format("las").option("point_format", 3).mode("overwrite").save(a)
    assert lasformat.table(spark, a).count() == 7
    spark.sql(f"CREATE TEMPORARY VIEW some_las USING las OPTIONS (path '{a}')")
    assert spark.sql("SELECT count(*) FROM some_las WHERE X >= 0").first()[0] == 7
    with pytest.raises(Exception, match="return_number"):
        df.withColumn("return_number", F.lit(9)).write.format("las").option("point_format", 3).mode("append").save(b)


def test_files_of_other_scales(spark, tmp_path):
    """Boxes of files are compared in the scales of the first, whose raw numbers the filter means."""
    path = str(tmp_path / "x")
    for s in (1.0, 0.5):
        las.write(PointCloud(spark.createDataFrame([(10, 20, 30)], "X int, Y int, Z int").coalesce(1), 0, (s, s, s)), path)
    t = lasformat.table(spark, path)
    all_x = sorted(r.X for r in t.collect())
    for x in all_x:
        assert [r.X for r in t.where(F.col("X") == x).collect()] == [x]


def test_header_travels(spark, tmp_path):
    """GPS-time flag, source, GUID, system, software and date pass through load, filter, convert and write."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b.las")
    las.write(PointCloud(points(spark, 20), 6, version="1.4", meta=META), a)
    c = las.load(spark, a)
    assert c.meta == META
    onefile.write_file(c.filter("X >= 10").convert(7).rescaled((0.1,) * 3, (1.0,) * 3), b)
    assert las.load(spark, b).meta == META and las.load(spark, b).fmt == 7


def test_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(onefile, "PIECE_BYTES", 30 * 17)
    late = lasfile.Record("me", 9, "late", bytes(300), True)
    c = PointCloud(points(spark), 6, (0.5, 0.25, 1.0), (1.0, 2.0, 3.0), "1.4", records=(late, lasfile.Record("me", 1, "", b"abc")))
    path = str(tmp_path / "deep" / "one.las")
    onefile.write_file(c, path)
    raw = open(path, "rb").read()
    h = lasfile.Header.read(raw)
    pts = np.frombuffer(raw, h.dtype, h.count, h.offset)
    assert pts["X"].tolist() == list(range(1000)) and len(raw) == h.offset + 1000 * h.record_size + 60 + 300
    assert h.maxs == (999 * 0.5 + 1, 1998 * 0.25 + 2, 999 + 3.0) and h.returns[0] == 500 and [r.extended for r in h.records] == [False, True]
    onefile.write_file(c.filter("X < 0"), path)
    assert lasfile.Header.read(open(path, "rb").read()).count == 0 and not list(tmp_path.glob("deep/*.tmp"))
    with pytest.raises(IncompatibleData, match="positional"):
        monkeypatch.setattr(las, "_whole", lambda s, p: "hdfs://x/y.las")
        onefile.write_file(c, path)


@pytest.mark.parametrize("fmt,version", [(3, "1.2"), (6, "1.4")])
def test_append(spark, tmp_path, fmt, version):
    """Records, reserved bytes and header constants stay; extended records move; counts, box and returns grow."""
    own = [lasfile.Record("me", 1, "short", b"abc")] + ([lasfile.Record("me", 9, "late", bytes(range(256)) * 40, True)] if fmt == 6 else [])
    first = PointCloud(points(spark, 100, fmt), fmt, (1.0,) * 3, (0.0,) * 3, version, records=tuple(own), meta=META)
    path = str(tmp_path / "x.las")
    onefile.write_file(first, path)
    before = open(path, "rb").read()
    more = PointCloud(points(spark, 700, fmt, 5, start=200), fmt, (0.5,) * 3, (0.0,) * 3, version)  # other scales: the file's count
    for k in range(2):
        onefile.append_file(more, path)
    raw = open(path, "rb").read()
    h, old = lasfile.Header.read(raw), lasfile.Header.read(before)
    pts = np.frombuffer(raw, h.dtype, h.count, h.offset)
    want = [*range(100), *[int(np.rint(x * 0.5)) for x in range(200, 900)] * 2]
    assert pts["X"].tolist() == want and h.count == 1500 and h.maxs[0] == max(want) and h.mins[0] == 0.0
    assert h.returns[0] == old.returns[0] + 700 and h.meta() == META and raw[: old.offset][:96] == before[:96]
    assert [(r.user_id, r.record_id, r.data, r.extended) for r in h.records] == [(r.user_id, r.record_id, r.data, r.extended) for r in own]
    assert raw[old.offset - 54 - 3 : old.offset] == before[old.offset - 54 - 3 : old.offset]
    if fmt == 3:
        assert struct.unpack_from("<I", raw, 107)[0] == 1500
    onefile.append_file(first.filter("X < 0"), path)
    assert open(path, "rb").read() == raw
    with pytest.raises(IncompatibleData):
        onefile.append_file(PointCloud(points(spark, 5, 1), 1), path)
    with pytest.raises(IncompatibleData):
        onefile.append_file(first.add_dims(dims.ExtraDim("more", "u1")), path)


def test_open_modes(spark, tmp_path):
    path, folder = str(tmp_path / "o.las"), str(tmp_path / "o")
    c = PointCloud(points(spark, 30, 3), 3, (1.0,) * 3)
    for p in (path, folder):
        with lasformat.open_las(spark, p, "w", header=c) as f:
            f.write(c)
            f.write(c)
        with lasformat.open_las(spark, p, "a") as f:
            f.write(PointCloud(points(spark, 10, 3), 3, (2.0,) * 3))
        got = lasformat.open_las(spark, p)
        assert got.df.count() == 70 and got.scales == (1.0,) * 3 and got.df.agg(F.max("X")).first()[0] == 29
        with pytest.raises(ValueError):
            f.write(c)
    for bad in (dict(mode="x"), dict(mode="w"), dict(mode="r", header=c), dict(mode="a", header=c)):
        with pytest.raises(ValueError):
            lasformat.open_las(spark, path, **bad)
    with pytest.raises(IncompatibleData), lasformat.open_las(spark, path, "a") as f:
        f.write(PointCloud(points(spark, 10, 1), 1))


def test_narrowed_dimensions(spark):
    """A value that the new format cannot hold raises, whichever dimension it is of."""
    wide = PointCloud(points(spark, 4, 6).withColumn("scan_angle", F.lit(300)).withColumn("classification", F.lit(200)), 6)
    with pytest.raises(Exception, match="classification outside 0..31"):
        wide.convert(3).df.collect()
    c = PointCloud(points(spark, 4, 6).withColumn("return_number", F.lit(9)), 6)
    with pytest.raises(Exception, match="return_number outside 0..7"):
        c.convert(1).df.collect()
    assert PointCloud(points(spark, 4, 6), 6).convert(3).df.count() == 4


# ---------------------------------------------------------------------------------------------------- waveforms


def waves(spark, n, samples, top):
    return spark.range(n).select(F.col("id").alias("packet"), F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: (F.col("id") * 31 + k) % F.lit(top + 1)).cast("array<bigint>").alias("waveform"))


@pytest.mark.parametrize("bits", [8, 16, 32, 64])
def test_payload(spark, tmp_path, bits, monkeypatch):
    """Write, read back: only packets in use, once each, in rank order; samples and points as they were."""
    monkeypatch.setattr(wdp, "RUN_BYTES", 100)
    size, samples = bits // 8 * 5, 5
    df = points(spark, 200, 9).withColumns({"wavepacket_index": F.col("X") % 3, "wavepacket_offset": (F.col("X") * 7 % 40 * size).cast("long"), "wavepacket_size": F.lit(size).cast("long")})
    records = tuple(lasfile.pack_wave_descriptor(k, bits, samples, 1000) for k in (1, 2))
    c = PointCloud(df, 9, version="1.4", records=records)
    w = waves(spark, 40, samples, (1 << min(bits, 20)) - 1)
    path = str(tmp_path / "w.las")
    wdp.write(c, w, path)
    used = sorted({x * 7 % 40 for x in range(200) if x % 3})
    top = (1 << min(bits, 20)) - 1
    assert (tmp_path / "w.wdp").stat().st_size == len(used) * size
    kind = {8: "u1", 16: "<u2", 32: "<u4", 64: "<u8"}[bits]
    assert np.fromfile(tmp_path / "w.wdp", kind).reshape(-1, samples).tolist() == [[(p * 31 + k) % (top + 1) for k in range(samples)] for p in used]
    back = wdp.load(spark, path)
    assert back.meta.encoding & 4
    for r in back.df.collect():
        p = r.X * 7 % 40
        assert list(r.waveform) == ([(p * 31 + k) % (top + 1) for k in range(samples)] if r.X % 3 else [0] * samples)
        assert (r.wavepacket_offset, r.wavepacket_size) == ((used.index(p) * size, size) if r.X % 3 else (0, 0))
    all_of_it = wdp.packets(spark, str(tmp_path / "w.wdp"), wdp.Layout(bits, samples))
    assert all_of_it.count() == len(used)
    raw = (tmp_path / "w.wdp").read_bytes()
    (tmp_path / "w.wdp").write_bytes(raw[:-3])
    with pytest.raises(Exception, match="ends within"):
        wdp.load(spark, path).df.collect()


def test_payload_errors(spark, tmp_path):
    df = points(spark, 10, 9).withColumns({"wavepacket_index": F.lit(1), "wavepacket_offset": (F.col("X") * 8).cast("long"), "wavepacket_size": F.lit(8).cast("long")})
    one = lasfile.pack_wave_descriptor(1, 8, 8, 1000)
    c = PointCloud(df, 9, version="1.4", records=(one,))
    path = str(tmp_path / "w.las")
    with pytest.raises(ValueError, match="external"):
        wdp.gathered(c, path)
    with pytest.raises(ValueError, match="descriptors"):
        wdp.layout_of(())
    with pytest.raises(ValueError, match="several"):
        wdp.layout_of((one, lasfile.pack_wave_descriptor(2, 16, 8, 1000)))
    with pytest.raises(ValueError, match="compressed"):
        wdp.layout_of((lasfile.pack_wave_descriptor(2, 16, 8, 1000, compression=1),))
    with pytest.raises(Exception, match="not given"):
        wdp.write(c, waves(spark, 5, 8, 255), path)
    with pytest.raises(Exception, match="outside 0..255"):
        wdp.write(c, waves(spark, 10, 8, 300).withColumn("waveform", F.transform("waveform", lambda x: x + 256)), path)
    with pytest.raises(Exception, match="more than once"):
        wdp.write(c, waves(spark, 10, 8, 255).unionAll(waves(spark, 1, 8, 255)), path)
    assert not list(tmp_path.glob("*"))
    none = PointCloud(df.withColumn("wavepacket_index", F.lit(0)), 9, version="1.4", records=(one,))
    wdp.write(none, waves(spark, 10, 8, 255), path)
    assert (tmp_path / "w.wdp").stat().st_size == 0 and not las.load(spark, path).meta.encoding & 4


def test_reference_systems(spark, tmp_path):
    """A new one takes the old one's place; keys give their numbers and texts."""
    keys = struct.pack("<4H", 1, 1, 0, 4) + struct.pack("<4H", 1024, 0, 1, 1) + struct.pack("<4H", 2057, 34736, 1, 1) + struct.pack("<4H", 2049, 34737, 6, 3) + struct.pack("<4H", 2062, 34736, 2, 0)
    old = (lasfile.Record("LASF_Projection", 34735, "", keys), lasfile.Record("LASF_Projection", 34736, "", struct.pack("<2d", 1.5, 6378137.0)), lasfile.Record("LASF_Projection", 34737, "", b"ab|WGS84|\0"), lasfile.Record("me", 1, "", b"x"))
    assert lasfile.geo_keys(old) == {1024: 1, 2057: 6378137.0, 2049: "WGS84", 2062: (1.5, 6378137.0)} and lasfile.geo_keys(()) == {}
    c = PointCloud(points(spark, 5, 3), 3, records=old, meta=META)
    new = las.with_crs(c, epsg=2154)
    assert [(r.user_id, r.record_id) for r in new.records] == [("me", 1), ("LASF_Projection", 34735)] and lasfile.crs_of(list(new.records)) == 2154
    wkt = las.with_crs(new.convert(6), wkt="LOCAL")
    assert lasfile.crs_of(list(wkt.records)) == "LOCAL" and wkt.meta.encoding == META.encoding | 16
    las.write(wkt, str(tmp_path / "w"))
    h = las.headers(spark, str(tmp_path / "w")).first()
    assert (h.crs, h.system, h.source_id, h.encoding, h.created) == ("LOCAL", "scanner", 77, 17, META.created) and h.guid == "03020100-0504-0706-0809-0a0b0c0d0e0f"


def test_equality(spark):
    df = points(spark, 30, 3).withColumn("point_idx", F.col("X").cast("long"))
    a = PointCloud(df, 3)
    assert cloud.equal(a, PointCloud(df.repartition(3), 3)) and not cloud.equal(a, PointCloud(df, 3, (1.0,) * 3))
    b = PointCloud(df.where("X < 29").withColumn("red", F.when(F.col("X") == 4, 9).otherwise(F.col("red"))), 3)
    assert sorted((r.point_idx, r.names) for r in cloud.differences(a, b).collect()) == [(4, ["red"]), (29, None)]
    with pytest.raises(IncompatibleData):
        cloud.differences(a, PointCloud(df.drop("red"), 3))


def test_positions(spark):
    e = spark.range(10).withColumnRenamed("id", "point_idx")
    idx = lambda df: sorted(r.point_idx for r in df.collect())
    assert idx(cloud.sliced(e, -4, None, 2, total=10)) == [6, 8] and idx(cloud.sliced(e, 2, 100, 3, total=10)) == [2, 5, 8] == idx(cloud.sliced(e, 2, 10, 3))
    assert idx(cloud.taken(e, [-1, 0, -1], total=10)) == [0, 9, 9]
    assert (cloud.seek(3, 0, 10), cloud.seek(-3, 2, 10), cloud.seek(0, 2, 10)) == (3, 7, 10)
    for bad in (lambda: cloud.taken(e, [10], total=10), lambda: cloud.taken(e, [-11], total=10), lambda: cloud.seek(11, 0, 10), lambda: cloud.seek(1, 2, 10)):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: cloud.sliced(e, -1, 5), lambda: cloud.sliced(e, 0, 5, -1), lambda: cloud.seek(0, 3, 10)):
        with pytest.raises(ValueError):
            bad()
    z = cloud.zeros(spark, 4, 6)
    assert z.df.count() == 4 and z.version == "1.4" and z.df.agg(F.max("X"), F.max("gps_time")).first() == (0, 0.0)
