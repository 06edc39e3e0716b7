import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pointengine import dims
from pointengine.errors import FilterSyntaxError, UnknownDimension, UnsupportedFormat
from pointengine.functions import exprs
from pointengine.operators import spatial
from pointengine.operators.cloud import PointCloud
from pointengine.plans import dsl
from pointengine.sources import las, lasfile


def cloud(spark):
    rows = [(1, 1.0), (2, 5.0), (3, 11.0)]
    return PointCloud(spark.createDataFrame([(int(x), 0, 0, c) for c, x in rows], "X int, Y int, Z int, classification int"), 0, (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))


@pytest.mark.parametrize("text,want", [("classification == 2 or classification == 3 and x > 10.0", {2, 3}), ("(classification == 2 or classification == 3) and x > 10.0", {3}), ("not classification == 2", {1, 3}), ("classification == 1 and x > 10 or classification == 3", set()), ("classification in [1, 3]", {1, 3}), ("((classification == 1))", {1})])
def test_filter_language(spark, text, want):
    assert {r.classification for r in cloud(spark).filter(text).df.collect()} == want


@pytest.mark.parametrize("text", ["point_source_id <> 128", "point_source_id 128", "a == 1 )", "(a == 1", "a ==", ""])
def test_filter_errors(text):
    with pytest.raises(FilterSyntaxError):
        dsl.parse(text)


def test_unknown_name(spark):
    with pytest.raises(UnknownDimension):
        cloud(spark).filter("nowhere == 1")


def test_literals():
    assert dsl.number(" 17 ") == 17 and dsl.number("0.3") == 0.3 and dsl.number_list("(4, 5, 6)") == [4, 5, 6]
    with pytest.raises(FilterSyntaxError):
        dsl.number("238a")


def test_rescaling_vectors(spark):
    c = PointCloud(spark.createDataFrame([(i, i, i) for i in (1, 2, 3, 4)], "X int, Y int, Z int"), 0, (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))
    new = c.rescaled((0.5, 0.1, 0.01), (0.0, 0.0, 0.0))
    assert sorted(map(tuple, new.df.collect())) == [(2, 10, 100), (4, 20, 200), (6, 30, 300), (8, 40, 400)]
    assert sorted(map(tuple, new.rescaled((0.5, 0.1, 0.01), (1.0, 20.0, 30.0)).df.collect()))[0] == (0, -190, -2900)


def test_pack_is_inverse_and_checked(spark):
    d = spark.range(8).select(exprs.pack(F.lit(0xFF), 0x38, F.col("id")).alias("c"), "id")
    assert all(r.v == r.id for r in d.select(exprs.unpack(F.col("c"), 0x38).alias("v"), "id").collect())
    for bad in (8, -1):
        with pytest.raises(PySparkException):
            spark.range(1).select(exprs.pack(F.lit(0), 0x38, F.lit(bad))).collect()


def test_catalogue():
    assert dims.lost_dimensions(3, 0) == ["gps_time", "red", "green", "blue"]
    assert [f for f in range(11) if dims.waveform_capable(f)] == [4, 5, 9, 10]
    assert [dims.record_size(f) for f in range(11)] == [20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67]
    assert lasfile.EXTRA.size == 192
    with pytest.raises(UnsupportedFormat):
        dims.check_version("1.5", 3)


@pytest.mark.parametrize("fmt", range(11))
def test_las_round_trip(spark, tmp_path, fmt):
    names = dims.dimension_names(fmt)
    extra = (dims.ExtraDim("height", "f8"), dims.ExtraDim("code", "i2", no_data=-1))
    cols = [F.col("id").cast("int").alias(n) if n in "XYZ" else (F.col("id") % 2).cast("double" if n == "gps_time" else "int").alias(n) for n in names]
    df = spark.range(100, numPartitions=3).select(*cols, F.col("id").cast("double").alias("height"), (F.col("id") - 50).cast("short").alias("code"))
    las.write(PointCloud(df, fmt, version=dims.preferred_version(fmt), extra=extra), str(tmp_path / "out"))
    back = las.read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*[F.col(n).cast("double") for n in (*names, "height", "code")]).collect())) == sorted(map(tuple, df.select(*[F.col(n).cast("double") for n in (*names, "height", "code")]).collect()))
    assert sum(r.points for r in las.headers(spark, str(tmp_path / "out")).collect()) == 100


def test_header_and_records():
    h = lasfile.Header(6, "1.4", records=lasfile.crs_records(6, wkt="LOCAL"), extra=(dims.ExtraDim("v", "i4", 3, (1.0, 2.0, 3.0), (10.0, 20.0, 30.0), -10000),))
    back = lasfile.Header.read(h.pack())
    assert back.extra == h.extra and lasfile.crs_of(back.records) == "LOCAL"
    assert lasfile.crs_of(lasfile.crs_records(3, 2994)) == 2994
    with pytest.raises(OverflowError):
        lasfile.records_of({"classification": np.array([54])}, lasfile.Header(3), 1)


def test_codec_plug_in():
    h = lasfile.Header(0)
    lasfile.register_codec("fake", lambda raw, head, first, n: raw)
    try:
        assert lasfile.decompress(b"abc", h, 0, 1) == b"abc"
    finally:
        lasfile.CODECS.clear()
    with pytest.raises(Exception, match="no codec"):
        lasfile.decompress(b"", h, 0, 1)


def test_levels():
    assert spatial.parse_levels("3") == range(3, 4) and spatial.parse_levels("1:3") == range(1, 3) and spatial.parse_levels("1..=3") == range(1, 4)
