"""Boxes, tiles, neighbours and the octree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs
from ..sources import scratch
from .cloud import AXES, PointCloud
from .ranks import running


def box(cloud: PointCloud, lo: tuple[float, ...], hi: tuple[float, ...]) -> PointCloud:
    """Points within bounds of two or three axes, ends included, compared as raw integers."""
    cond = F.lit(True)
    for a, s, o, x, y in zip(AXES, cloud.scales, cloud.offsets, lo, hi, strict=False):
        cond = cond & F.col(a).between(exprs.unscale_literal(x, s, o), exprs.unscale_literal(y, s, o))
    return cloud.filter(cond)


def distance(dims: dict[str, float]) -> Column:
    total = None
    for c, v in dims.items():
        d = (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        total = d if total is None else total + d
    return F.sqrt(total)


def tile_of(size: int) -> tuple[Column, Column]:
    """Half-open tiles: every point has exactly one."""
    return tuple(F.floor(F.col(a) / F.lit(float(size))).cast("int") for a in ("X", "Y"))


def tiles_inclusive(df: DataFrame, size: int) -> DataFrame:
    """Each point once for every tile that holds it, ends included: one to four rows, made without a join."""
    def cells(a: str) -> Column:
        t = F.floor(F.col(a) / F.lit(float(size))).cast("int")
        return F.when(F.col(a) % size == 0, F.array(t - 1, t)).otherwise(F.array(t))

    return df.withColumn("tx", F.explode(cells("X"))).withColumn("ty", F.explode(cells("Y")))


#: Cells at the finest scale of a neighbour search, along an axis, at most; and cells there for each point, along an axis of a square of even density.
FINEST, FINER = 1 << 20, 64
#: A query takes the finest scale at which the cells around it hold so many points for each one asked for.
ENOUGH = 4


def nearest(points: DataFrame, queries: DataFrame, k: int, cell: float = 0.0) -> DataFrame:
    """(query, id, rank, d2) of the k nearest points (id, x, y[, z]) of every query (query, x, y[, z]), ties to the smaller id; a query's own
    id does not count.

    Points are counted once in fine cells, whose counts are summed up to ever coarser scales, so that cells follow the density.  A query first
    meets the points of its own cell and those around it, at the finest scale at which these hold enough.  If its k-th distance
    reaches beyond them, it meets the cells within that distance too.  Both are equi-joins on cells, for all queries at once, without rounds.
    Of points at one place only the k + 1 of smallest ids can count, so a place that many share is no hot key.  cell: the least side.
    """
    axes = [a for a in ("x", "y", "z") if a in points.columns]
    near = [f"c{a}" for a in axes]
    ends = points.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{a}{m}") for a in axes for f, m in ((F.min, 0), (F.max, 1))]).first()
    if not ends.n:
        return points.sparkSession.createDataFrame([], "query long, id long, rank int, d2 double")
    extent = max(*[ends[f"{a}1"] - ends[f"{a}0"] for a in axes], float(cell), 1e-300)
    side = max(float(cell), extent / min(FINEST, FINER * ends.n ** (1 / len(axes))))
    top = math.ceil(math.log2(extent / side)) + 1  # here the cells around hold everything
    own = F.row_number().over(Window.partitionBy(*axes).orderBy("id"))
    points = points.select("id", *axes).withColumn("_n", own).where(F.col("_n") <= k + 1).drop("_n")
    at = lambda a, s: F.floor((F.col(a) - F.lit(ends[f"{a}0"])) / (F.lit(side) * F.pow(F.lit(2.0), s.cast("double")))).cast("long")
    up = lambda c: F.expr(f"shiftright({c}, s)").alias(c)
    scales = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("s")
    fine = points.groupBy(*[at(a, F.lit(0)).alias(c) for a, c in zip(axes, near, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    cells = fine.select(scales, *near, "n").select("s", *map(up, near), "n").groupBy("s", *near).agg(F.sum("n").alias("n"))
    asked = queries.select("query", *axes)
    held_in = {a: F.greatest(F.least(F.col(a), F.lit(ends[f"{a}1"])), F.lit(ends[f"{a}0"])) for a in axes}
    home = lambda a: F.floor((held_in[a] - F.lit(ends[f"{a}0"])) / (F.lit(side) * F.pow(F.lit(2.0), F.col("s").cast("double")))).cast("long")

    def spread(q: DataFrame, low: str, high: str) -> DataFrame:
        """Rows (..., s, bounds of each axis) once for every cell between the bounds."""
        for a, c in zip(axes, near, strict=True):
            q = q.withColumn(c, F.explode(F.sequence(F.expr(low.format(a=a)), F.expr(high.format(a=a)))))
        return q

    def around(q: DataFrame) -> DataFrame:
        return spread(q.withColumns({f"_{a}": home(a) for a in axes}), "_{a} - 1", "_{a} + 1")

    held = around(asked.select("query", *axes, scales)).join(cells, ["s", *near]).groupBy("query", "s").agg(F.sum("n").alias("n"))
    scale = held.where(F.col("n") > ENOUGH * k).groupBy("query").agg(F.min("s").alias("s"))
    # a query outside the points' box starts from its border, with cells as large as its way there
    away = sum((F.abs(F.col(a) - held_in[a]) for a in axes), F.lit(0.0))
    least = F.when(away > side, F.least(F.ceil(F.log2(away / side)), F.lit(top))).otherwise(F.lit(0)).cast("int")
    asked = asked.join(scale, "query", "left").withColumn("s", F.greatest(F.coalesce("s", F.lit(top)), least))

    def met(cells_of: DataFrame) -> DataFrame:
        """(query, id, d2) of the points in cells (query, axes, s, cells): by the fine cells that lie in them, so that no point is copied for scales
        that nobody asks for."""
        wanted = cells_of.select("s", *near).distinct()
        inner = fine.select(*[F.col(c).alias(f"f{c}") for c in near], scales).select(*[f"f{c}" for c in near], "s", *[F.expr(f"shiftright(f{c}, s)").alias(c) for c in near])
        inner = inner.join(wanted, ["s", *near])
        placed = points.select("id", *[F.col(a).alias(f"p{a}") for a in axes], *[at(a, F.lit(0)).alias(f"f{c}") for a, c in zip(axes, near, strict=True)])
        placed = placed.join(inner, [f"f{c}" for c in near]).select("id", *[f"p{a}" for a in axes], "s", *near)
        d2 = None
        for a in axes:
            d = (F.col(f"p{a}") - F.col(a)) * (F.col(f"p{a}") - F.col(a))
            d2 = d if d2 is None else d2 + d
        return cells_of.join(placed, ["s", *near]).where(F.col("query") != F.col("id")).select("query", "id", d2.alias("d2"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= k)

    first = best(met(around(asked))).select("query", "id", "d2")
    reach = first.groupBy("query").agg(F.max("d2").alias("r"), F.count(F.lit(1)).alias("n"))
    own_side = F.lit(side) * F.pow(F.lit(2.0), F.col("s").cast("double"))
    rest = asked.where(F.col("s") < top).join(reach, "query").withColumns({"_r": F.sqrt("r") * (1 + 1e-12), "_side": own_side})
    for a in axes:
        rest = rest.withColumns({f"_{a}": home(a), f"_{a}0": F.floor((F.col(a) - F.lit(ends[f"{a}0"]) - F.col("_r")) / F.col("_side")).cast("long"), f"_{a}1": F.floor((F.col(a) - F.lit(ends[f"{a}0"]) + F.col("_r")) / F.col("_side")).cast("long")})
    inside = lambda c, a: (F.col(c) >= F.col(f"_{a}") - 1) & (F.col(c) <= F.col(f"_{a}") + 1)
    beyond, known = F.lit(False), F.lit(True)
    for a, c in zip(axes, near, strict=True):
        beyond = beyond | ~inside(f"_{a}0", a) | ~inside(f"_{a}1", a)
        known = known & inside(c, a)
    last = {a: F.floor((F.lit(ends[f"{a}1"]) - F.lit(ends[f"{a}0"])) / F.col("_side")).cast("long") for a in axes}
    rest = rest.where(beyond).withColumns({f"_{a}0": F.greatest(f"_{a}0", F.lit(0)) for a in axes} | {f"_{a}1": F.greatest(F.least(F.col(f"_{a}1"), last[a]), F.lit(0)) for a in axes})
    for a in axes:
        rest = rest.withColumn(f"_{a}0", F.least(f"_{a}0", f"_{a}1"))
    more = met(spread(rest, "_{a}0", "_{a}1").where(~known).select("query", *axes, "s", *near))
    return best(first.unionByName(more)).select("query", "id", "rank", "d2")


#: Levels of tiles that are counted in one pass, at least.
TILE_LEVELS = 4


def recursive_tiles(df: DataFrame, most: int, side: float, depth: int = 16) -> DataFrame:
    """Every point with the tile (t_level, tx, ty) it falls into: squares of ``side`` are quartered until none holds more than
    ``most`` points, or ``depth`` times.  Points without X or Y have none.

    A few levels are counted at a time, from the top: only points of tiles that hold too many go on to the next.  Points of a pass's finest cells
    are counted once, and the counts of its coarser tiles are their sums.  Of the cells that a pass counts there are at most so many for every ``most``
    points as its levels quarter a tile into, so they stay few beside the points, wherever these lie.
    """
    spark = df.sparkSession
    df = df.withColumns({f"_f{a.lower()}": F.floor(F.col(a) / F.lit(side / 2.0**depth)).cast("long") for a in ("X", "Y")}).where("_fx IS NOT NULL AND _fy IS NOT NULL")
    step = max(TILE_LEVELS, int(math.log(most, 4)) - 1 if most > 1 else 0)
    ends = sorted({0, *range(step, depth, step), depth})
    cell = lambda end: {f"_c{a}": F.expr(f"shiftright(_f{a}, {depth} - {end})") for a in "xy"}
    at = ["_cx", "_cy"]
    rest, tile, tagged = df.select("_fx", "_fy"), None, df.withColumn("_end", F.lit(0))
    for k, end in enumerate(ends):
        cells, path = rest.select(*[v.alias(c) for c, v in cell(end).items()]).groupBy(*at).agg(F.count(F.lit(1)).alias("_n")), scratch.folder(spark, "tiles")
        cells.write.parquet(path)
        cells = spark.read.parquet(path)
        first = ends[k - 1] + 1 if k else 0
        levels = cells.select("*", F.explode(F.sequence(F.lit(first), F.lit(end))).alias("t_level"))
        levels = levels.select("*", *[F.expr(f"shiftright({c}, {end} - t_level)").alias(t) for c, t in zip(at, ("tx", "ty"), strict=True)])
        size = levels.groupBy("t_level", "tx", "ty").agg(F.sum("_n").alias("_all"))
        fit = levels.join(size, ["t_level", "tx", "ty"]).where((F.col("_all") <= most) | (F.col("t_level") == depth))
        own = fit.groupBy(*at).agg(F.min("t_level").alias("t_level")).select(F.lit(end).alias("_end"), *at, "t_level")
        tile = own if tile is None else tile.unionByName(own)
        full = cells.where(F.col("_n") > most).select(*at)
        if end == depth or full.isEmpty():
            break
        rest = df.select("_fx", "_fy").withColumns(cell(end)).join(full, at, "left_semi").select("_fx", "_fy")
        tagged = tagged.withColumns(cell(end)).join(full.withColumn("_next", F.lit(ends[k + 1])), at, "left").withColumn("_end", F.coalesce("_next", "_end")).drop(*at, "_next")
    placed = tagged.withColumns(cell("_end")).join(tile, ["_end", *at])
    return placed.withColumns({t: F.expr(f"shiftright({f}, {depth} - t_level)") for t, f in (("tx", "_fx"), ("ty", "_fy"))}).drop("_end", "_fx", "_fy", *at)


# ------------------------------------------------------------------------------------------------------- octree


def voxel(level: Column, x: Column, y: Column, z: Column, side: float) -> list[Column]:
    """Keys vx, vy, vz of a point at a level of a cube from the origin."""
    own = F.lit(float(side)) / F.pow(F.lit(2.0), level.cast("double"))
    return [F.floor(v / own).cast("int").alias(n) for v, n in ((x, "vx"), (y, "vy"), (z, "vz"))]


def children(nodes: DataFrame) -> DataFrame:
    """The eight children of every node (level, vx, vy, vz)."""
    d = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dir")
    n = nodes.select("level", "vx", "vy", "vz", d)
    bit = lambda k: F.shiftright("dir", k).bitwiseAND(F.lit(1))
    return n.select((F.col("level") + 1).alias("level"), *[(F.shiftleft(v, 1).bitwiseOR(bit(k))).alias(v) for k, v in enumerate(("vx", "vy", "vz"))])


def node_bounds(nodes: DataFrame, side: float) -> DataFrame:
    own = F.lit(float(side)) / F.pow(F.lit(2.0), F.col("level").cast("double"))
    return nodes.select("level", "vx", "vy", "vz", *[(F.col(v) * own).alias(f"{v[1]}_min") for v in ("vx", "vy", "vz")], *[((F.col(v) + 1) * own).alias(f"{v[1]}_max") for v in ("vx", "vy", "vz")])


def overlaps(side: float, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    own = F.lit(float(side)) / F.pow(F.lit(2.0), F.col("level").cast("double"))
    cond = F.lit(True)
    for v, x, y in zip(("vx", "vy", "vz"), lo, hi, strict=True):
        cond = cond & (F.col(v) * own <= F.lit(float(y))) & ((F.col(v) + 1) * own >= F.lit(float(x)))
    return cond


def reachable(nodes: DataFrame, side: float, lo, hi, levels: range) -> DataFrame:
    """Nodes of the levels that overlap the box and whose ancestors are all in the index and overlap it.

    Every node that is hit is listed under the keys of its ancestors and its own; those keys meet the hit nodes in one equi-join, and
    a node counts if all of its level + 1 keys were met.
    """
    hit = nodes.where(overlaps(side, lo, hi) & (F.col("level") < levels.stop))
    key = ("level", "vx", "vy", "vz")
    rest = [c for c in nodes.columns if c not in key]
    asked = hit.where(F.col("level") >= levels.start).select(*nodes.columns, F.explode(F.sequence(F.lit(0), F.col("level"))).alias("up"))
    asked = asked.select(*nodes.columns, (F.col("level") - F.col("up")).alias("a_level"), *[F.expr(f"shiftright({v}, up)").alias(f"a_{v}") for v in key[1:]])
    have = hit.select(*[F.col(c).alias(f"a_{c}") for c in key])
    met = asked.join(have, [f"a_{c}" for c in key]).groupBy(*key).agg(F.count(F.lit(1)).alias("_met"), *[F.first(c).alias(c) for c in rest])
    return met.where(F.col("_met") == F.col("level") + 1).select(*nodes.columns)


def sampled_levels(df: DataFrame, xyz: list[Column], side: float, depth: int, cells: int, order: Column) -> DataFrame:
    """Points with the octree level that they belong to, from 0 to depth: a level-of-detail sampling from the root down.

    The nodes of level l are cut into ``cells`` grid cells an axis.  A point belongs to the first level at which it comes first, by ``order``, among all
    points of its cell, and to the deepest where it never does; so every level and those above it hold exactly one point of every occupied
    cell, until the deepest adds the rest.  As cells lie within cells, who is first in a coarse cell is first in every finer one: the finest cells'
    first points are found by one aggregation of all points, and their levels by a second one over those.  Points alike in place and
    order share a level.  No task holds a cell: both aggregations combine before they shuffle.
    """
    own = [F.floor(v / F.lit(side / 2.0**depth / cells)).cast("long").alias(f"_c{k}") for k, v in enumerate(xyz)]
    keyed = df.withColumn("_first", order).select("*", *own)
    at = ["_c0", "_c1", "_c2"]
    best = keyed.groupBy(*at).agg(F.min("_first").alias("_first"))
    up = best.select(*at, "_first", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_up"))
    up = up.select(*at, "_first", "_up", *[F.expr(f"shiftright({c}, _up)").alias(f"{c}u") for c in at])
    heads = up.groupBy("_up", *[f"{c}u" for c in at]).agg(F.min(F.struct("_first", *at)).alias("_h"))
    level = heads.groupBy("_h").agg(F.max("_up").alias("_up")).select("_h.*", (F.lit(depth) - F.col("_up")).cast("int").alias("level"))
    out = keyed.join(level, [*at, "_first"], "left")
    return out.withColumn("level", F.coalesce("level", F.lit(depth))).drop(*at, "_first")


def levels_of(spacing: float, resolution: float) -> range:
    """Levels that a resolution asks for: from the root to the first that is as fine."""
    return range(0, max(1, math.ceil(math.log2(spacing / resolution)) + 1))


def levels_needed(spacing: float, resolution: Column) -> Column:
    """How many levels a resolution asks for, as levels_of() does: one more than there are halvings that are still coarser."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.lit(float(spacing)) / F.pow(F.lit(2.0), k.cast("double")) > resolution)) + 1


def parse_levels(text: str) -> range:
    """``n``, ``a:b``, ``a..b`` or ``a..=b``."""
    for mark, more in (("..=", 1), ("..", 0), (":", 0)):
        if mark in text:
            a, b = text.split(mark)
            return range(int(a), int(b) + more)
    return range(int(text), int(text) + 1)


def parse_bounds(text: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """``x_min,y_min,x_max,y_max`` or with z: the lower and the upper corner."""
    v = [float(x) for x in text.replace("[", " ").replace("]", " ").replace(",", " ").split()]
    if len(v) not in (4, 6) or any(a > b for a, b in zip(v[: len(v) // 2], v[len(v) // 2 :], strict=True)):
        raise ValueError(f"{text!r} is no box of two or three axes")
    return tuple(v[: len(v) // 2]), tuple(v[len(v) // 2 :])


#: Deepest level whose cells part the files of an octree table, and cells of all levels together that have a folder, at most.
KEY_LEVEL, FOLDERS = 2, 256


def _cell(keys: list[Column], up: int) -> Column:
    """The name of the cell that parts a node's files: its level and keys.  It lies ``up`` levels above the node's cell of KEY_LEVEL, or above the
    node itself where that is coarser; levels below 0 are wider than the root's cube."""
    deep = F.greatest(F.col("level") - F.lit(KEY_LEVEL), F.lit(0)) + F.lit(up)
    return F.concat_ws("_", (F.col("level") - deep).cast("string"), *[F.floor(v / F.pow(F.lit(2.0), deep.cast("double"))).cast("long").cast("string") for v in keys])


def write_octree(df: DataFrame, level: Column, xyz: tuple[Column, Column, Column], side: float, path: str) -> None:
    """points/: Parquet parted by level and coarse cell, sorted by key inside; nodes/: the index with its point counts.

    Cells are as fine as FOLDERS allows, so that the number of files follows the tasks and not the ground that the points cover.  Spark deals the points
    to ranges of keys of about equal size; a hash of the coordinates splits a node that has many.
    """
    keys = ("vx", "vy", "vz")
    keyed = df.withColumn("level", level.cast("int"))
    keyed = keyed.select("*", *voxel(F.col("level"), *xyz, side), F.xxhash64(*xyz).alias("_split"))
    fine = keyed.select("level", *[F.floor(F.col(k) / F.pow(F.lit(2.0), F.greatest(F.col("level") - F.lit(KEY_LEVEL), F.lit(0)).cast("double"))).cast("long").alias(k) for k in keys]).distinct()
    tried = fine.select("level", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("up"), *keys).select("level", "up", *[F.expr(f"shiftright({k}, up)").alias(k) for k in keys]).distinct()
    counts = tried.groupBy("up").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each of 33 widths
    up = min((r.up for r in counts if r.n <= FOLDERS), default=32)
    keyed = keyed.withColumn("cell", _cell([F.col(k) for k in keys], up))
    keyed.repartitionByRange("level", "cell", *keys, "_split").sortWithinPartitions("level", "cell", *keys).drop("_split").write.partitionBy("level", "cell").parquet(f"{path}/points")
    table = df.sparkSession.read.parquet(f"{path}/points")
    table.groupBy("level", *keys).agg(F.count(F.lit(1)).alias("point_count")).write.parquet(f"{path}/nodes")


def query_octree(spark: SparkSession, path: str, side: float, lo, hi, levels: range | None = None, resolution: float | None = None, spacing: float = 0.0) -> DataFrame:
    """Points of the nodes that a box reaches, at given levels or at a resolution; the caller's filter tests the points themselves.

    Cells that the box misses become partition filters, so their folders are not read; the index decides which nodes of the others count.
    """
    if levels is not None and resolution is not None:
        raise ValueError("levels or a resolution, not both")
    if levels is None:
        levels = levels_of(spacing, resolution) if resolution else range(0, 64)
    nodes = spark.read.parquet(f"{path}/nodes").where(F.col("level") < levels.stop)
    name = F.split("cell", "_")
    own = F.lit(float(side)) / F.pow(F.lit(2.0), F.get(name, F.lit(0)).cast("double"))
    wanted = (F.col("level") >= levels.start) & (F.col("level") < levels.stop)
    for k, (a, b) in enumerate(zip(lo, hi, strict=True), 1):
        at = F.get(name, F.lit(k)).cast("double")
        wanted = wanted & (at * own <= F.lit(float(b))) & ((at + 1) * own >= F.lit(float(a)))
    table = spark.read.parquet(f"{path}/points").where(wanted).where(overlaps(side, lo, hi))
    return table.join(reachable(nodes, side, lo, hi, levels).select("level", "vx", "vy", "vz"), ["level", "vx", "vy", "vz"], "left_semi")


def with_layout(nodes: DataFrame, record: int = 20) -> DataFrame:
    """byte_size and offset of nodes that are stored one after another, in order of their keys.

    Nodes are numbered within (level, vx); the sums of these groups are put in order by a level-wise window over one row a
    group, so no task sorts more than the nodes of one group, or the groups of one level.
    """
    order = Window.partitionBy("level", "vx").orderBy("vy", "vz")
    sized = nodes.withColumn("byte_size", (F.col("point_count") * record).cast("long"))
    part = sized.groupBy("level", "vx").agg(F.sum("byte_size").alias("t"), F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy("level").orderBy("vx").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("level", "vx", "t", "c", F.coalesce(F.sum("t").over(within), F.lit(0)).alias("pt"), F.coalesce(F.sum("c").over(within), F.lit(0)).alias("pc"))
    total = part.groupBy("level").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # one row a level
    base = total.select("level", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("lt"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("lc"))
    out = sized.withColumn("own", F.sum("byte_size").over(order) - F.col("byte_size")).withColumn("rn", F.row_number().over(order))
    out = out.join(part.select("level", "vx", "pt", "pc"), ["level", "vx"]).join(F.broadcast(base), "level")
    return out.select(*nodes.columns, "byte_size", (F.col("lt") + F.col("pt") + F.col("own")).cast("long").alias("offset"), (F.col("lc") + F.col("pc") + F.col("rn")).cast("long").alias("number"))


def contiguous(nodes: DataFrame) -> DataFrame:
    """(grp, first_byte, n_bytes, nodes) of every run of touching byte ranges (offset, byte_size), numbered from 1 by place.

    Where a range starts that no other ends at, a run starts; ranges are ranked, and summed up, by ranges of offsets.
    """
    ends = nodes.select((F.col("offset") + F.col("byte_size")).alias("offset"), F.lit(1).alias("touched")).distinct()
    marked = nodes.join(ends, "offset", "left").withColumn("new", F.when(F.col("touched").isNull(), 1).otherwise(0))
    out = running(marked, "offset", "new", "grp")
    return out.groupBy("grp").agg(F.min("offset").alias("first_byte"), F.sum("byte_size").alias("n_bytes"), F.count(F.lit(1)).alias("nodes"))
