"""Hard negatives by dual-tree search: a tree over anchors against a tree over candidates, pairs of nodes pruned by intervals.

Rows are dealt to the leaves of a binary tree of median planes, and the rows of a leaf are ordered by planes of their own into blocks, so that
nodes of a block are runs of rows.  A node is a ball: centre c, radius r, and the greatest norm.  The inner products of all anchors of a
node with all candidates of another lie within ca.cc +- (ra|cc| + rc|ca| + ra rc) and within the product of the greatest norms.  A pair whose
interval misses what every anchor of the node still needs is dropped with everything below it: leaves against the candidates' whole
tree first, by which blocks that are not needed never move, then, inside a task, node against node down to runs of some rows, which are scored
exactly.  What an anchor needs follows the best rows found so far.

1. positives: two leaves near each anchor leaf give a first five a row; then every pair of leaves that can still change them;
2. negatives: every pair of leaves whose interval meets a window between 30 and 90 per cent of a positive score.

Trees are fitted on at most SAMPLE rows, which decides speed alone: every row is in a leaf, radii are those of all rows, results are exact.  Nothing is
broadcast but planes, centres and radii of at most MAX_LEAVES leaves.  A leaf however full (a vector that a third of all rows
share) is dealt to several tasks by row number, as blocks of bounded size; pairs of blocks are dealt by anchor block and a part of the
candidate blocks.  Vectors without structure leave little to prune: then blocks of anchors meet all blocks of candidates.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part.  A row of null vec_id is a candidate and comes
last among ties.  Rows that repeat a vec_id or a vector are rows of their own (an anchor's copy may be its positive).  A shorter vector counts as
having zeros behind.  Components beyond +-2^25 after scaling are held at that, so that sums fit into 64 bits.  An empty table gives no rows, nor
does an anchor without positives or without rows in its windows.  Other columns are not looked at; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, whole_groups

#: Rows on which a tree is fitted, and its leaves, at most.
SAMPLE, MAX_LEAVES = 1 << 14, 1 << 12
#: Rows of a block of anchors and of candidates, and of the runs that are scored at once.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 1024, 2048
ANCHOR_RUN, CANDIDATE_RUN = 64, 128
#: Rows of a leaf that one task puts into blocks; blocks of candidates that meet a block of anchors in one task.
DEALT_ROWS, DEALT_BLOCKS = 1 << 16, 64
#: Leaves of candidates that are scored first.
SEEDS = 2
HELD = 1 << 25
_LOW, _HIGH = -(2**63) + 1, 2**63 - 1

_DATA = ("n", "runs", "ids", "nulls", "labels", "rows", "vectors")
_BLOCKS = "leaf int, n int, radius double, norm double, runs binary, ids binary, nulls binary, labels binary, rows binary, vectors binary"


def rows_of(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows that take part, components as whole numbers floor(256 x)."""
    x = F.col(vector)
    good = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))
    label = F.col("label").cast("int")
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * 256), F.lit(HELD)), F.lit(-HELD)).cast("int")
    ours = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & good)
    return ours.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, held).alias("v"))


# ------------------------------------------------------------------------------------------------------- trees


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width), np.int32)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _direction(x: np.ndarray) -> np.ndarray:
    """From one far row to the row farthest from it."""
    far = lambda c: x[int(np.argmax(((x - c) ** 2).sum(1)))]
    p = far(x.mean(0))
    return far(p) - p


class Tree:
    """Median planes of a sample, as a complete binary tree; leaves have centres."""

    def __init__(self, sample: np.ndarray, rows: int, block: int):
        self.depth = min(int(math.log2(MAX_LEAVES)), max(0, math.ceil(math.log2(max(1.0, rows / (0.75 * block))))))
        inner, width = (1 << self.depth) - 1, sample.shape[1]
        self.normals, self.at = np.zeros((inner, width)), np.zeros(inner)
        self.centres = np.zeros((1 << self.depth, width))
        self._grow(sample.astype(np.float64), 0, np.zeros(width))

    def _grow(self, x: np.ndarray, node: int, above: np.ndarray) -> None:
        centre = x.mean(0) if len(x) else above
        if node >= len(self.at):
            self.centres[node - len(self.at)] = centre
            return
        if len(x) > 1:
            self.normals[node] = _direction(x)
            p = x @ self.normals[node]
            self.at[node] = np.median(p)
            right = p > self.at[node]
        else:
            right = np.zeros(len(x), bool)
        self._grow(x[~right], 2 * node + 1, centre)
        self._grow(x[right], 2 * node + 2, centre)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[node]) > self.at[node])
        return node - len(self.at)


def _ordered(x: np.ndarray, idx: np.ndarray, run: int, out: list[np.ndarray]) -> None:
    """Splits rows by planes through the widest gap of their middle half, down to runs of at most ``run`` rows, in order."""
    n = len(idx)
    if n <= run:
        out.append(idx)
        return
    p = x[idx] @ _direction(x[idx].astype(np.float64))
    order = np.argsort(p, kind="stable")
    gap = np.diff(p[order])[n // 4 : n - n // 4 - 1]
    k = n // 4 + 1 + int(np.argmax(gap)) if len(gap) and gap.max() > 0 else n // 2
    _ordered(x, idx[order[:k]], run, out)
    _ordered(x, idx[order[k:]], run, out)


def _blocks(tree: Tree, width: int, size: int, run: int):
    """Sorted rows of whole groups to blocks of at most ``size`` rows, each in the order of its own planes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "g", size):
            x = _matrix(batch.column("v"), width)
            g, leaf = batch.column("g").to_numpy(), batch.column("leaf").to_numpy()
            ids, rid, label = batch.column("vec_id"), batch.column("rid").to_numpy(), batch.column("label").to_numpy()
            null = np.asarray(ids.is_null()).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            for lo, hi in zip(heads, np.append(heads[1:], len(g)), strict=True):
                parts: list[np.ndarray] = []
                _ordered(x, np.arange(lo, hi), run, parts)
                ends = np.cumsum([len(q) for q in parts])
                order, first = np.concatenate(parts), 0
                while first < len(parts):  # whole runs, up to size rows
                    at = ends[first] - len(parts[first])
                    last = max(first + 1, int(np.searchsorted(ends, at + size, "right")))
                    i = order[at : ends[last - 1]]
                    heads_of = np.append(at, ends[first : last - 1]) - at
                    first = last
                    v, c = x[i].astype(np.float64), tree.centres[leaf[lo]]
                    radius, norm = np.sqrt(((v - c) ** 2).sum(1).max()), np.sqrt((v**2).sum(1).max())
                    cols = [[int(leaf[lo])], [len(i)], [radius], [norm], [heads_of.astype(np.int32).tobytes()], *([a[i].tobytes()] for a in (ids, null, label, rid)), [x[i].astype(np.int32).tobytes()]]
                    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c2, t) for c2, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in _BLOCKS.split(", ")])

    return build


def _in_blocks(rows: DataFrame, n: int, width: int, size: int, run: int) -> tuple[Tree, DataFrame]:
    """The tree of the rows, and their blocks (block, leaf, ...), written to the shared folder."""
    sample = rows.select("v", F.xxhash64("rid").alias("h")).orderBy("h").limit(SAMPLE).toArrow().combine_chunks()
    tree = Tree(_matrix(sample.column("v").chunk(0), width) if len(sample) else np.zeros((0, width)), n, size)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("leaf", pa.array(tree.leaf_of(_matrix(b.column("v"), width).astype(np.float64)).astype(np.int32)))

    routed = materialise(rows.mapInArrow(route, "rid long, vec_id long, label int, v array<int>, leaf int"))
    count = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a leaf
    parts = {r.leaf: -(-r.n // DEALT_ROWS) for r in count if r.n > DEALT_ROWS}
    split = F.coalesce(F.create_map(*[F.lit(int(x)) for kv in parts.items() for x in kv])[F.col("leaf")], F.lit(1)) if parts else F.lit(1)
    g = (F.col("leaf").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("rid"), split)).alias("g")
    tasks = max(1, min(1 << 14, n // (DEALT_ROWS // 4)))
    dealt = routed.select("*", g).repartition(tasks, "g").sortWithinPartitions("g")
    blocks = materialise(dealt.mapInArrow(_blocks(tree, width, size, run), _BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    discard(routed)
    return tree, blocks


class Nodes:
    """Balls of the leaves that hold rows and of the nodes above them, root first."""

    def __init__(self, tree: Tree, leaves: list):
        here = np.array([r.leaf for r in leaves], np.int64)
        full = np.zeros(len(tree.centres), bool)
        radius, norm = np.zeros(len(full)), np.zeros(len(full))
        full[here], radius[here], norm[here] = True, [r.radius for r in leaves], [r.norm for r in leaves]
        self.levels = [(tree.centres, radius, norm, full)]
        while len(self.levels[0][0]) > 1:
            c, r, m, f = self.levels[0]
            up = (c[::2] + c[1::2]) / 2
            own = [np.where(f[k::2], np.sqrt(((c[k::2] - up) ** 2).sum(1)) + r[k::2], 0.0) for k in (0, 1)]
            self.levels.insert(0, (up, np.maximum(*own), np.maximum(m[::2], m[1::2]), f[::2] | f[1::2]))

    def near(self, centre: np.ndarray, k: int) -> np.ndarray:
        """The k leaves whose centres have the greatest inner products with this one."""
        c, _, _, full = self.levels[-1]
        have = np.flatnonzero(full)
        return have[np.argsort(-(c[have] @ centre), kind="stable")[:k]]

    def met(self, centre: np.ndarray, radius: float, norm: float, lo: float, hi: float) -> np.ndarray:
        """Leaves that can hold a row whose inner product with some row of the ball lies between lo and hi."""
        found = np.zeros(1, np.int64)
        for k, (c, r, m, full) in enumerate(self.levels):
            found = found if not k else np.concatenate([2 * found, 2 * found + 1])
            found = found[full[found]]
            low, high = intervals(centre[None], np.array([radius]), np.array([norm]), c[found], r[found], m[found])
            found = found[(high[0] >= lo) & (low[0] <= hi)]
        return np.sort(found)


def intervals(ca: np.ndarray, ra: np.ndarray, ma: np.ndarray, cc: np.ndarray, rc: np.ndarray, mc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values all inner products of rows of each ball a (row) with rows of each ball c (column) lie."""
    na, nc = np.sqrt((ca**2).sum(1))[:, None], np.sqrt((cc**2).sum(1))[None]
    slack = ra[:, None] * nc + rc[None] * na + ra[:, None] * rc[None]
    mid, most = ca @ cc.T, ma[:, None] * mc[None]
    room = 1e-9 * (np.abs(mid) + slack + most) + 1e-6  # for rounding
    return np.maximum(mid - slack, -most) - room, np.minimum(mid + slack, most) + room


# ----------------------------------------------------------------------------------------------------- scoring


class Block:
    """A block in a task: its rows, and the balls of its runs and of the nodes above them."""

    def __init__(self, row: dict, width: int):
        self.n = row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.null = np.frombuffer(row["nulls"], np.uint8)
        self.label, self.rid = np.frombuffer(row["labels"], np.int32), np.frombuffer(row["rows"], np.int64)
        self.v = np.frombuffer(row["vectors"], np.int32).reshape(self.n, width).astype(np.float64)
        norm = np.sqrt((self.v**2).sum(1))
        self.levels, self.heads, head = [], [], np.frombuffer(row["runs"], np.int32).astype(np.int64)
        while True:  # from the runs up, two nodes to one
            size = np.diff(np.append(head, self.n))
            c = np.add.reduceat(self.v, head) / size[:, None]
            r = np.sqrt(np.maximum.reduceat(((self.v - np.repeat(c, size, 0)) ** 2).sum(1), head))
            self.levels.insert(0, (c, r, np.maximum.reduceat(norm, head)))
            self.heads.insert(0, head)
            if len(head) == 1:
                break
            head = head[::2]
        self.most = norm.max()

    def run(self, k: int) -> slice:
        head = self.heads[-1]
        return slice(int(head[k]), int(head[k + 1]) if k + 1 < len(head) else self.n)


class Search:
    """The best ``keep`` rows of every anchor of a block, for each of its windows."""

    def __init__(self, a: Block, same: bool, low: np.ndarray, high: np.ndarray, keep: int):
        self.a, self.same, self.low, self.high, self.keep, self.scored = a, same, low.copy(), high, keep, 0
        self.best: dict[int, list[np.ndarray]] = {}  # of a run: anchor, window, score, id, whether it is null

    def meet(self, c: Block) -> None:
        """Descend from both roots; runs that are left are scored, the most promising first."""
        a = self.a
        exact = a.most * c.most < 2.0**52
        ia = ic = np.zeros(1, np.int64)
        for k in range(max(len(a.levels), len(c.levels))):
            da, dc = (min(k, len(x.levels) - 1) for x in (a, c))
            if k:
                ga = [2 * ia, 2 * ia + 1] if k < len(a.levels) else [ia]
                gc = [2 * ic, 2 * ic + 1] if k < len(c.levels) else [ic]
                ia, ic = (np.concatenate(x) for x in zip(*((p, q) for p in ga for q in gc), strict=True))
                ok = (ia < len(a.levels[da][0])) & (ic < len(c.levels[dc][0]))
                ia, ic = ia[ok], ic[ok]
            lo, hi = np.minimum.reduceat(self.low.min(1), a.heads[da]), np.maximum.reduceat(self.high.max(1), a.heads[da])
            low, high = intervals(*a.levels[da], *c.levels[dc])
            low, high = low[ia, ic], high[ia, ic]
            ok = (high >= lo[ia]) & (low <= hi[ia])
            ia, ic, high = ia[ok], ic[ok], high[ok]
        order = np.lexsort((-high, ia))
        for k in order:
            s = a.run(ia[k])
            if high[k] >= self.low[s].min():  # it has risen since
                self._score(int(ia[k]), s, c, c.run(ic[k]), exact)

    def _score(self, run: int, s: slice, c: Block, t: slice, exact: bool) -> None:
        a = self.a
        self.scored += (s.stop - s.start) * (t.stop - t.start)
        v = (a.v[s] @ c.v[t].T).astype(np.int64) if exact else a.v[s].astype(np.int64) @ c.v[t].astype(np.int64).T
        fit = (a.label[s][:, None] == c.label[t]) & (a.rid[s][:, None] != c.rid[t]) if self.same else a.label[s][:, None] != c.label[t]
        new = []
        for w in range(self.low.shape[1]):
            i, j = np.nonzero(fit & (v >= self.low[s, w][:, None]) & (v <= self.high[s, w][:, None]))
            new.append((i + s.start, np.full(len(i), w), v[i, j], c.ids[t][j], c.null[t][j].astype(np.int64)))
        rows = [np.concatenate(x) for x in zip(*new, *([self.best[run]] if run in self.best else []), strict=True)]
        if not len(rows[0]):
            return
        # keep the best rows of each window, and need no score below them
        order = np.lexsort((rows[3], rows[4], -rows[2], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        key = rows[0] * self.low.shape[1] + rows[1]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        place = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
        last = place == self.keep - 1
        self.low[rows[0][last], rows[1][last]] = np.maximum(self.low[rows[0][last], rows[1][last]], rows[2][last])
        self.best[run] = [x[place < self.keep] for x in rows]

    def rows(self, block: int) -> pa.RecordBatch:
        none = [np.zeros(0, np.int64)] * 5
        at, window, score, ids, null = (np.concatenate(x) for x in zip(none, *self.best.values(), strict=True))
        cols = [pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(self.a.ids[at], mask=self.a.null[at] > 0), pa.array(window.astype(np.int32)), pa.array(score), pa.array(ids, mask=null > 0)]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _FOUND.split(", ")])


_FOUND = "block long, pos int, anchor_id long, k int, score long, vec_id long"


def _searched(width: int, same: bool, windows: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, block = None, None
        for batch in batches:
            names = [n for n in batch.schema.names if n[:2] == "c_"]
            for k, own in enumerate(batch.column("block").to_pylist()):
                if own != block:
                    if search:
                        yield search.rows(block)
                    block = own
                    a = Block({n: batch.column(n)[k].as_py() for n in _DATA}, width)
                    low = np.full((a.n, windows), _LOW if same else _HIGH)
                    high = np.full((a.n, windows), _HIGH if same else _LOW)
                    for need in batch.column("need")[k].as_py() or ():
                        low[need["pos"], need["k"]], high[need["pos"], need["k"]] = need["lo"], need["hi"]
                    search = Search(a, same, low, high, keep)
                search.meet(Block({n[2:]: batch.column(n)[k].as_py() for n in names}, width))
        if search:
            yield search.rows(block)

    return run


def _paired(pick, nodes: Nodes, centres: np.ndarray):
    """(leaf, c_leaf) of anchor leaves (leaf, radius, norm, lo, hi) and what pick finds for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                got = pick(nodes, centres[r["leaf"]], r)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), r["leaf"], np.int32)), pa.array(got.astype(np.int32))], ["leaf", "c_leaf"])

    return run


def _nearest(nodes: Nodes, centre: np.ndarray, r: dict) -> np.ndarray:
    return nodes.near(centre, SEEDS)


def _needed(nodes: Nodes, centre: np.ndarray, r: dict, seeded: bool = False) -> np.ndarray:
    got = nodes.met(centre, r["radius"], r["norm"], r["lo"], r["hi"])
    return np.setdiff1d(got, nodes.near(centre, SEEDS)) if seeded else got


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first rows of every anchor and window, numbered from 1."""
    order = Window.partitionBy("block", "pos", "k").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v array<int>).

    An anchor's positives are the rows of its label with the greatest inner products; for each, the negatives are the first rows of
    other labels with low * positive <= 100 * score <= high * positive.  Ties go to the smaller vec_id.
    """
    rows = materialise(rows.select("vec_id", "label", "v").withColumn("rid", F.monotonically_increasing_id()))
    rows = rows.select("rid", "vec_id", "label", "v", is_anchor.alias("_anchor"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_anchor").alias("a"), F.max(F.size("v")).alias("w")).first()
    if not size.a:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, size.w)
    tree, blocks = _in_blocks(rows.where("_anchor").drop("_anchor"), size.a, width, ANCHOR_BLOCK, ANCHOR_RUN)
    c_tree, c_blocks = _in_blocks(rows.drop("_anchor"), size.n, width, CANDIDATE_BLOCK, CANDIDATE_RUN)
    balls = [F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("blocks")]
    leaves, c_leaves = (b.groupBy("leaf").agg(*balls).drop("blocks") for b in (blocks, c_blocks))
    nodes = Nodes(c_tree, c_leaves.collect())  # one row a leaf
    parts = -(-c_blocks.count() // DEALT_BLOCKS)
    c_data = c_blocks.select(F.col("block").alias("c_block"), *[F.col(n).alias(f"c_{n}") for n in _DATA])
    a_data = blocks.select("block", *_DATA)

    def scored(pick, asked: DataFrame, need: DataFrame | None, same: bool, windows: int, keep: int) -> DataFrame:
        """Leaves to pairs of leaves, to pairs of blocks, to the best rows."""
        pairs = asked.mapInArrow(_paired(pick, nodes, tree.centres), "leaf int, c_leaf int")
        pairs = pairs.join(blocks.select("leaf", "block"), "leaf").join(c_blocks.select(F.col("leaf").alias("c_leaf"), F.col("block").alias("c_block")), "c_leaf")
        part = F.pmod(F.xxhash64("c_block"), F.lit(parts)).alias("part")
        a = a_data.join(need, "block", "left") if need is not None else a_data.withColumn("need", F.lit(None).cast("array<struct<pos:int,k:int,lo:bigint,hi:bigint>>"))
        a = a.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        dealt = pairs.select("block", "c_block", part).join(c_data, "c_block").join(a, ["block", "part"])
        found = dealt.repartition("block", "part").sortWithinPartitions("block", "part").drop("part", "c_block")
        return materialise(found.mapInArrow(_searched(width, same, windows, keep), _FOUND))

    needs = lambda df, lo, hi: df.groupBy("block").agg(F.collect_list(F.struct("pos", "k", lo.alias("lo"), hi.alias("hi"))).alias("need"))
    asked = leaves.withColumns({"lo": F.lit(0.0), "hi": F.lit(0.0)})
    seeds = scored(_nearest, asked, None, True, 1, positives)
    # an anchor of which fewer rows are known needs any score
    known = _best(seeds, positives).groupBy("block", "pos").agg(F.min("score").alias("lo"), F.count(F.lit(1)).alias("m")).where(F.col("m") == positives)
    known = materialise(known.select("block", "pos", F.lit(0).alias("k"), "lo", F.lit(_HIGH).alias("hi")))
    least = blocks.join(known.groupBy("block").agg(F.min("lo").alias("lo"), F.count(F.lit(1)).alias("m")), "block", "left")
    least = least.groupBy("leaf").agg(F.min(F.when(F.col("m") == F.col("n"), F.col("lo").cast("double")).otherwise(F.lit(float("-inf")))).alias("lo"))
    asked = leaves.join(least, "leaf").withColumn("hi", F.lit(float("inf"))).select("leaf", "radius", "norm", "lo", "hi")
    more = scored(partial(_needed, seeded=True), asked, needs(known, F.col("lo"), F.col("hi")), True, 1, positives)
    best = _best(seeds.unionByName(more), positives)
    best = materialise(best.select("block", "pos", "anchor_id", (F.col("rank") - 1).alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole numbers: low * p <= 100 * s <= high * p
    p = F.col("positive_score")
    wide = lambda x: x.cast("decimal(38,0)")
    lo = F.ceil(wide(p) * low / 100).cast("long")
    hi = F.floor(wide(p) * high / 100).cast("long")
    windows = best.select("block", "pos", "k", lo.alias("lo"), hi.alias("hi")).where(F.col("lo") <= F.col("hi"))
    span = windows.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(blocks.select("block", "leaf"), "block")
    span = span.groupBy("leaf").agg(F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi"))
    asked = leaves.join(span, "leaf").select("leaf", "radius", "norm", "lo", "hi")
    worst = scored(_needed, asked, needs(windows, F.col("lo"), F.col("hi")), False, positives, negatives)
    out = best.join(_best(worst, negatives).select("block", "pos", "k", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["block", "pos", "k"])
    out = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(blocks, c_blocks, seeds, known, more, best, worst)
    return out


def hard_negatives(embeddings: DataFrame, every: int = 100, flipped: int = 7, labels: int = 10) -> DataFrame:
    """mine() over a table (vec_id, embedding, label): anchors are rows whose vec_id is divisible by ``every``; where it is divisible by ``flipped``,
    the label first becomes the next of ``labels``."""
    rows = rows_of(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % flipped == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return mine(rows, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
