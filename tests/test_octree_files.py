"""Octree files: levels by sampling, pages, what is read and what is not."""

import random

import pytest
from pyspark.sql import functions as F

from pointengine import dims
from pointengine.errors import IncompatibleData
from pointengine.operators import spatial
from pointengine.operators.cloud import PointCloud
from pointengine.sources import las, lasfile, lasformat, octreefile, onefile


SCALES = (0.5, 0.5, 0.5)


def made(spark, n=4000, fmt=7, seed=4):
    rng = random.Random(seed)
    rows = [(rng.randrange(4096), rng.randrange(4096), rng.randrange(256), i, float(i)) for i in range(n)] + [(5, 5, 5, n + i, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "X int, Y int, Z int, intensity int, gps_time double")
    zero = [F.lit(0).alias(d) for d in dims.dimension_names(fmt) if d not in ("X", "Y", "Z", "intensity", "gps_time")]
    return rows, PointCloud(df.select("*", *zero), fmt, SCALES, (10.0, 20.0, 30.0), "1.4", records=(lasfile.Record("me", 1, "", b"abc"), lasfile.Record("me", 2, "", b"late" * 50, True)))


def test_sampled_levels(spark):
    """By the definition: the first level at which a point comes first in its cell."""
    rng = random.Random(8)
    rows = [(float(rng.randrange(64)), float(rng.randrange(64)), float(rng.randrange(8)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "x double, y double, z double, id long")
    order = F.struct((F.col("id") * 7919 % 1009).alias("a"), "id")
    got = {r.id: r.level for r in spatial.sampled_levels(df, [F.col(c) for c in "xyz"], 64.0, 4, 2, order).collect()}
    assert len(got) == len(rows)
    want = {}
    for lv in range(4, -1, -1):
        first = {}
        for x, y, z, i in rows:
            cell = tuple(v // (64 / 2**lv / 2) for v in (x, y, z))
            first[cell] = min(first.get(cell, (10**9, 0)), (i * 7919 % 1009, i))
        want |= {i: lv for _, i in first.values()}
    assert got == {i: want.get(i, 4) for *_, i in rows} and set(got.values()) == set(range(5))
    for lv in range(4):  # a level and those above it: one point a cell
        cells = [tuple(v // (64 / 2**lv / 2) for v in r[:3]) for r in rows if got[r[3]] <= lv]
        assert len(cells) == len(set(cells)) == len({tuple(v // (64 / 2**lv / 2) for v in r[:3]) for r in rows})


@pytest.mark.parametrize("page_levels", [1, 3])
def test_file(spark, tmp_path, page_levels, monkeypatch):
    monkeypatch.setattr(onefile, "PIECE_BYTES", 5000)
    rows, cloud = made(spark)
    path = str(tmp_path / "o.las")
    octreefile.write(cloud, path, 5, 4, page_levels=page_levels)
    assert [r.user_id for r in las.load(spark, path).records][:2] == ["copc", "me"] and las.load(spark, path).records[-1].data == b"late" * 50
    assert sorted(r.intensity for r in lasformat.table(spark, path, "intensity").collect()) == list(range(4300))
    nodes = octreefile.index(spark, path).collect()
    assert sum(n.point_count for n in nodes) == 4300 and len({(n.level, n.vx, n.vy, n.vz) for n in nodes}) == len(nodes)
    by_place = sorted(nodes, key=lambda n: n.offset)
    assert all(a.offset + a.byte_size == b.offset for a, b in zip(by_place, by_place[1:])) and max(n.level for n in nodes) == 5
    # every point lies in its node
    every = octreefile.query(spark, path)
    side = octreefile.info_of(lasfile.Header.read(open(path, "rb").read()))["halfsize"] * 2
    got = every.df.collect()
    assert sorted((r.X, r.Y, r.Z, r.intensity, r.gps_time) for r in got) == sorted(rows)
    low = [min(r[k] for r in rows) * 0.5 for k in range(3)]
    assert all((r.vx, r.vy, r.vz) == tuple(int((v * 0.5 - a) / (side / 2**r.level)) for v, a in zip((r.X, r.Y, r.Z), low)) for r in got)
    # boxes and levels
    lo, hi = (510.0, 320.0, 30.0), (800.0, 600.0, 90.0)
    inside = {r[3] for r in rows if all(a <= v * 0.5 + o <= b for v, o, a, b in zip(r[:3], (10, 20, 30), lo, hi))}
    assert {r.intensity for r in octreefile.query(spark, path, lo, hi).df.collect()} == inside
    level = {r.intensity: r.level for r in got}
    few = octreefile.query(spark, path, lo, hi, range(1, 4), names=["intensity"])
    assert {r.intensity for r in few.df.collect()} == {i for i in inside if 1 <= level[i] < 4} and "gps_time" not in few.df.columns
    assert {r.level for r in octreefile.query(spark, path, lo[:2], hi[:2], resolution=side / 4 / 2).df.collect()} <= {0, 1}
    with pytest.raises(ValueError):
        octreefile.query(spark, path, lo, hi, range(2), resolution=1.0)
    assert octreefile.query(spark, path, lo, hi, range(0)).df.count() == 0


def test_reads(spark, tmp_path, monkeypatch):
    """Only pages under the box are read, and nodes that touch are read at once."""
    _, cloud = made(spark)
    path = str(tmp_path / "o.las")
    octreefile.write(cloud, path, 5, 4, page_levels=1)
    read = []
    real = octreefile._read_ranges

    def noted(full):
        run = real(full)

        def f(batches):
            for b in batches:
                with open(str(tmp_path / "log"), "a") as log:
                    log.writelines(f"{x}\n" for x in b.column("offset").to_pylist())
                yield from run([b])

        return f

    monkeypatch.setattr(octreefile, "_read_ranges", noted)
    nodes = octreefile.index(spark, path, ((10.0, 20.0, 30.0), (60.0, 70.0, 200.0)))
    nodes.count()
    some = len((tmp_path / "log").read_text().split())
    octreefile.index(spark, path)
    read = (tmp_path / "log").read_text().split()
    assert len(set(read)) == len(read) - some and some * 10 < len(set(read))
    groups = octreefile.reads(nodes).collect()
    place = sorted((n.offset, n.byte_size) for n in nodes.collect())
    runs = 1 + sum(a + n != b for (a, n), (b, _) in zip(place, place[1:]))
    assert len(groups) == runs < len(place) and sum(g.n_bytes for g in groups) == sum(n for _, n in place)
    assert len(octreefile.reads(octreefile.index(spark, path)).collect()) == 1  # all of it, with one seek
    assert len(octreefile.reads(octreefile.index(spark, path), most=2000).collect()) > 10


def test_no_octree_file(spark, tmp_path):
    rows, cloud = made(spark, 10)
    path = str(tmp_path / "x.las")
    onefile.write_file(cloud, path)
    with pytest.raises(IncompatibleData, match="missing"):
        octreefile.index(spark, path)
    info = lasfile.pack_copc_info((0.0, 0.0, 0.0), 1.0, 1.0, 0, 0, (0.0, 0.0))
    onefile.write_file(cloud, path, [lasfile.Record("me", 1, "", b""), info])
    with pytest.raises(IncompatibleData, match="not the first"):
        octreefile.query(spark, path)
    octreefile.write(cloud.filter("X < 0"), path, 3)
    assert octreefile.query(spark, path).df.count() == 0
    with pytest.raises(IncompatibleData):
        octreefile.write(PointCloud(cloud.df, 3), path, 3)


def test_corners(spark, tmp_path):
    """Scales and offsets that binary fractions do not hold: points at the root's borders are in it."""
    rows = [(x, y, 91444 + z, x + y) for x in (1, 50, 19907) for y in (1, 9007) for z in (0, 77, 10408374)]
    cloud = PointCloud(spark.createDataFrame(rows, "X int, Y int, Z int, intensity int").withColumn("gps_time", F.lit(1.0)), 6, (0.01, 0.001, -0.01), (100.0, 0.0, 0.1), "1.4")
    path = str(tmp_path / "c.las")
    octreefile.write(cloud, path, 4)
    assert sorted((r.X, r.Y, r.Z) for r in octreefile.query(spark, path).df.collect()) == sorted(r[:3] for r in rows)
    assert min(min(r.vx, r.vy, r.vz) for r in octreefile.index(spark, path).collect()) == 0


def test_tasks_do_not_grow(spark, tmp_path, monkeypatch):
    """More points take more tasks, places are found without the points' bytes, and a node larger than READ_BYTES is read in parts."""
    rows, cloud = made(spark)
    monkeypatch.setattr(octreefile, "TASK_ROWS", 100)
    monkeypatch.setattr(octreefile, "READ_BYTES", 700)
    name, seen, pieces, placed = "spark.sql.shuffle.partitions", [], onefile.pieces, onefile.placed
    own = spark.conf.get(name)
    monkeypatch.setattr(onefile, "pieces", lambda *a: seen.append(spark.conf.get(name)) or pieces(*a))
    monkeypatch.setattr(onefile, "placed", lambda *a: seen.append(placed(*a)) or seen[-1])
    path = str(tmp_path / "o.las")
    octreefile.write(cloud, path, 3, 4)
    assert seen[0] == "43" and spark.conf.get(name) == own
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [plan[k + 1] for k, line in enumerate(plan) if "Window [" in line]
    assert below and not any("content" in line for line in below)
    assert max(n.byte_size for n in octreefile.index(spark, path).collect()) > 700
    got = octreefile.query(spark, path).df.collect()
    assert sorted((r.X, r.Y, r.Z, r.intensity, r.gps_time) for r in got) == sorted(rows)
    key = {(n.level, n.vx, n.vy, n.vz): n.point_count for n in octreefile.index(spark, path).collect()}
    count = {}
    for r in got:
        count[r.level, r.vx, r.vy, r.vz] = count.get((r.level, r.vx, r.vy, r.vz), 0) + 1
    assert count == key
