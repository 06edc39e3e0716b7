"""Operator 2: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node.  Three small random-projection trees give a first graph, which holds few true neighbours; NN-descent then
joins every node's neighbours, forward and backward, with each other and keeps each node's best, round after round, until hardly a link
changes: that is where the graph comes from.  Queries walk the graph greedily: they open the best nodes not yet opened until their best list holds no such
node.  The recall of a sample of queries is measured against brute force; while it is too low, lists are widened and the
walks go on from where they stand.  Scores on the way use half-precision copies; what is returned is measured again in
double precision on the original vectors.

Nodes are dealt to blocks by a hash of their ids.  A round is a few shuffles of messages between blocks, each of which holds what
one block tells another as packed arrays, so the rows that Spark moves are few and what a task holds is a block and its messages.
Only pairs that were not brought together in an earlier round are measured, and only scores that reach a list's worst are sent.
"""

from __future__ import annotations

import warnings
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_counted, lean, materialise
from .textbytes import mix

NEIGHBOURS = 48
#: Trees of the start, and nodes of a leaf, at most; in small tables leaves are a START-th of all, so that trees measure few of the pairs at any size.
TREES, LEAF, LEAST_LEAF, START = 3, 128, 12, 32
#: Rounds of the descent, at most, and the share of changed links from which on there is no further one.
ITERATIONS, CHANGED = 10, 0.05
#: Neighbours, forward and backward, that a node brings together in a round; the backward ones are a sample by hash.
FORWARD, BACKWARD = 30, 24
#: Partners that each of them keeps from one such meeting.
PARTNERS = 10
#: Nodes in a query's list, and how many of the best of them are opened, to begin with.
BEAM, OPENED = 256, 128
#: Nodes, and queries, of a block, about.
BLOCK, ASKING = 2048, 512
#: Queries whose recall is measured, and what it has to reach; until then the lists are doubled.
MEASURED, RECALL = 64, 0.92

_LISTS = "node long, ids array<long>, scores array<float>"


def _finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(name)
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(len(col), -1).astype(np.float32)


def _lists(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    off = pa.array(cut.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int64))), pa.ListArray.from_arrays(off, pa.array(scores.astype(np.float32)))], ["node", "ids", "scores"])


def _best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of every row, best first."""
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, 1)[:, :k]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), 1, kind="stable"), 1)
    return ids[at], np.take_along_axis(scores, at, 1)


def _leaves(planes: np.ndarray):
    """Rows (tree, leaf) of every node: the signs of its projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(planes.shape[1], dtype=np.int64)
        for batch in batches:
            if len(batch):
                x = _vectors(batch, "vec")
                for t, p in enumerate(planes):
                    leaf = ((x @ p.T > 0) * weight).sum(1) if len(p) else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf.astype(np.int64)), batch.column("node"), batch.column("vec")], ["tree", "leaf", "node", "vec"])

    return run


def _leaf_neighbours(table: pa.Table) -> pa.Table:
    batch = table.combine_chunks().to_batches()
    schema = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))])
    if not batch or table.num_rows < 2:
        return schema.empty_table()
    x, node = _vectors(batch[0], "vec"), batch[0].column("node").to_numpy()
    out = []
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        ids, sc = _best_rows(node, s, min(NEIGHBOURS, len(x) - 1))
        out.append(_lists(node[lo : lo + 512], ids.ravel(), sc.ravel(), np.arange(len(ids) + 1) * ids.shape[1]))
    return pa.Table.from_batches(out).cast(schema)


# Messages: rows (block, kind, n, a, b, c, d) of packed arrays, which block is told.  What kinds carry:
#   NODE   node ids, ascending, their vectors, the worst score of each list, -inf while it is not full
#   LIST   neighbours, scores, whether they are new: NEIGHBOURS a node, ids -1 and scores -inf behind the last; node ids
#   PUT    node, partner, score: an entry for each proposal
#   BACK   node, another that has it in its list, whether that is new
#   ASK    ids of nodes whose vectors block n asks for; TOLD: their ids, vectors, worst scores
#   MET    place of a node in its block, one that it brings together with others, whether that is new
#   FRESH  n: links that are new; LINKS: n: all links
#   QUERY  query ids, ascending, vectors
#   FOUND  query, node, score, best first; OPEN: query, node that was opened; FRONT: query, node to open; n: how many
#   LOOK   ids of nodes whose neighbours block n asks for; NEAR: their ids, neighbours
#   WANT   place of a query in block n, node; vectors of that block's queries, the worst score of each list
#   SCORED place of a query, node, score
_MESSAGE = "block int, kind int, n long, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in _MESSAGE.split(", ")]
NODE, LIST, PUT, BACK, ASK, TOLD, MET, FRESH, LINKS, QUERY, FOUND, OPEN, FRONT, LOOK, NEAR, WANT, SCORED = range(17)
#: Bytes of messages that a task hands over at once, about.
_SENT = 8 << 20

_I8, _F4, _F2, _U1, _I4 = np.int64, np.float32, np.float16, np.uint8, np.int32


def _block_of(node: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(node.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)


class _Out:
    """Messages of a task, handed over in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def put(self, block: int, kind: int, n: int = 0, *parts: np.ndarray) -> None:
        raw = [np.ascontiguousarray(x).tobytes() for x in parts] + [b""] * (4 - len(parts))
        self.rows.append((int(block), kind, int(n), *raw))
        self.size += sum(map(len, raw))

    def spread(self, to: np.ndarray, blocks: int, kind: int, n: int, *parts: np.ndarray) -> None:
        """One message to every block in ``to``, with the entries of the parts that go there, in their order."""
        order = np.argsort(to.astype(np.uint16) if blocks <= 1 << 16 else to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(blocks + 1))
        parts = tuple(x[order] for x in parts)
        for k in np.flatnonzero(cut[1:] > cut[:-1]):
            self.put(k, kind, n, *[x[cut[k] : cut[k + 1]] for x in parts])

    def batches(self, all_of_it: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_of_it or self.size > _SENT):
            kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), kinds, strict=True)], _NAMES)
            self.rows, self.size = [], 0


class _Told:
    """What one block was told: messages by kind, in the order (n, then as they came)."""

    def __init__(self, block: int):
        self.block, self.of = block, {}

    def add(self, kind: int, n: int, parts: tuple) -> None:
        self.of.setdefault(kind, []).append((n, parts))

    def each(self, kind: int, *types: type) -> Iterator[tuple]:
        for n, parts in self.of.get(kind, []):
            yield n, *[np.frombuffer(x, t) for x, t in zip(parts, types, strict=False)]

    def all(self, kind: int, *types: type) -> list[np.ndarray]:
        """The parts of all messages of a kind as one."""
        rows = [x[1:] for x in self.each(kind, *types)]
        return [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, t) for k, t in enumerate(types)]


def _acting(act: Callable[[_Told, _Out], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that lets every block of its rows, which stand together, act on what it was told: act(told, out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, out = None, _Out()
        for batch in batches:
            block, kind, n = (batch.column(k).to_numpy() for k in range(3))
            for r in range(len(batch)):
                if told is None or told.block != block[r]:
                    if told is not None:
                        act(told, out)
                        yield from out.batches()
                    told = _Told(int(block[r]))
                told.add(int(kind[r]), int(n[r]), tuple(batch.column(k)[r].as_buffer() for k in (3, 4, 5, 6)))
        if told is not None:
            act(told, out)
        yield from out.batches(True)

    return lean(run)


def _exchange(rows: DataFrame, act: Callable[[_Told, _Out], None]) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "kind", "n").mapInArrow(_acting(act), _MESSAGE)


def _kinds(rows: DataFrame, *kinds: int, without: str = "") -> DataFrame:
    """Messages of these kinds, with a part left out that is not needed."""
    rows = rows.where(F.col("kind").isin(*kinds))
    return rows.withColumn(without, F.lit(b"")) if without else rows


def _packed(vecs: DataFrame, graph: DataFrame, blocks: int) -> DataFrame:
    """Messages NODE and PUT out of (node, vec) and (node, ids, scores)."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for b in batches:
            if len(b):
                node, x = b.column("node").to_numpy(), np.frombuffer(b"".join(b.column("vec").to_pylist()), _F2).reshape(len(b), -1)
                out.spread(_block_of(node, blocks), blocks, NODE, 0, node, x)
                yield from out.batches()
        yield from out.batches(True)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for b in batches:
            node = np.repeat(b.column("node").to_numpy(), b.column("ids").value_lengths().to_numpy(zero_copy_only=False))
            out.spread(_block_of(node, blocks), blocks, PUT, 0, node, b.column("ids").flatten().to_numpy().astype(_I8), b.column("scores").flatten().to_numpy().astype(_F4))
            yield from out.batches()
        yield from out.batches(True)

    return vecs.select("node", "vec").mapInArrow(nodes, _MESSAGE).unionByName(graph.select("node", "ids", "scores").mapInArrow(lists, _MESSAGE))


def _ordered(scores: np.ndarray) -> np.ndarray:
    """32-bit keys that ascend as scores descend."""
    bits = scores.astype(_F4).view(np.uint32)
    return ~np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(0x80000000))


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of every row with different ids, by row, best first; of equal ids the first counts."""
    same = mix(ids.astype(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1)))
    o = np.argsort(same, kind="stable")
    o = o[np.append(True, same[o][1:] != same[o][:-1])[: len(o)]]
    o = o[np.argsort(ids[o], kind="stable")]
    o = o[np.argsort(row[o].astype(np.uint64) << np.uint64(32) | _ordered(scores[o]), kind="stable")]
    place = np.arange(len(o)) - np.searchsorted(row[o], row[o])
    return o[place < k]


def _merge(told: _Told, out: _Out) -> None:
    """Lists and proposals become lists: of every node the NEIGHBOURS best, what was in no list before is new."""
    node, vec = told.all(NODE, _I8, _F2)
    if not len(node):
        return
    order = np.argsort(node)
    node, vec = node[order], vec.reshape(len(node), -1)[order]
    target, ids, scores = told.all(PUT, _I8, _I8, _F4)
    row = np.searchsorted(node, target)
    old_ids, old_scores, _, of = told.all(LIST, _I8, _F4, _U1, _I8)
    old_row = np.repeat(np.searchsorted(node, of), NEIGHBOURS)
    held = old_ids >= 0
    row, ids, scores, old = (np.concatenate(x) for x in ((old_row[held], row), (old_ids[held], ids), (old_scores[held], scores), (np.ones(held.sum(), bool), np.zeros(len(ids), bool))))
    real = ids != node[row]
    row, ids, scores, old = row[real], ids[real], scores[real], old[real]
    o = _best(row, ids, scores, NEIGHBOURS)
    row, ids, scores, old = row[o], ids[o], scores[o], old[o]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    all_ids, all_scores, new = np.full((len(node), NEIGHBOURS), -1, _I8), np.full((len(node), NEIGHBOURS), -np.inf, _F4), np.zeros((len(node), NEIGHBOURS), _U1)
    all_ids[row, place], all_scores[row, place], new[row, place] = ids, scores, ~old
    out.put(told.block, NODE, 0, node, vec, all_scores[:, -1])
    out.put(told.block, LIST, 0, all_ids, all_scores, new, node)
    out.put(told.block, FRESH, int((~old).sum()))
    out.put(told.block, LINKS, len(ids))


def _changed(state: DataFrame) -> float:
    """The share of links that are new."""
    n = {r.kind: r.s for r in state.where(F.col("kind").isin(FRESH, LINKS)).groupBy("kind").agg(F.sum("n").alias("s")).collect()}
    return n.get(FRESH, 0) / max(n.get(LINKS, 0), 1)


def _backward(blocks: int) -> Callable[[_Told, _Out], None]:
    """Nodes tell the first FORWARD of their list of them; of one block's, a node hears of BACKWARD at most."""

    def act(told: _Told, out: _Out) -> None:
        ids, _, new, node = told.all(LIST, _I8, _F4, _U1, _I8)
        m, v, new = ids.reshape(len(node), NEIGHBOURS)[:, :FORWARD].ravel(), np.repeat(node, FORWARD), new.reshape(len(node), NEIGHBOURS)[:, :FORWARD].ravel()
        v, m, new = v[m >= 0], m[m >= 0], new[m >= 0]
        o = _some(m, v, new)
        out.spread(_block_of(m[o], blocks), blocks, BACK, told.block, m[o], v[o], new[o])

    return act


def _some(of: np.ndarray, other: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Places of BACKWARD entries of every node, at most: new ones first, then by hash."""
    o = np.argsort(mix(other.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + of.astype(np.uint64)))
    o = o[np.lexsort((1 - new[o], of[o]))]
    return o[np.arange(len(o)) - np.searchsorted(of[o], of[o]) < BACKWARD]


def _gather(blocks: int) -> Callable[[_Told, _Out], None]:
    """Whom every node brings together: itself, the first of its list and those that hold it.  Where none is new there is nothing to measure."""

    def act(told: _Told, out: _Out) -> None:
        ids, _, new, node = told.all(LIST, _I8, _F4, _U1, _I8)
        ahead, fresh = ids.reshape(len(node), NEIGHBOURS)[:, :FORWARD].ravel(), new.reshape(len(node), NEIGHBOURS)[:, :FORWARD].ravel()
        at = np.repeat(np.arange(len(node)), FORWARD)
        m, v, n = told.all(BACK, _I8, _I8, _U1)
        o = _some(m, v, n)
        row = np.concatenate([np.arange(len(node)), at[ahead >= 0], np.searchsorted(node, m[o])])
        met, new = np.concatenate([node, ahead[ahead >= 0], v[o]]), np.concatenate([np.zeros(len(node), _U1), fresh[ahead >= 0], n[o]])
        o = np.lexsort((1 - new, met, row))
        o = o[np.append(True, (met[o][1:] != met[o][:-1]) | (row[o][1:] != row[o][:-1]))[: len(o)]]
        row, met, new = row[o], met[o], new[o]
        keep = np.bincount(row, new, len(node))[row] > 0
        row, met, new = row[keep], met[keep], new[keep]
        out.put(told.block, MET, 0, row.astype(_I4), met, new)
        want = np.unique(met)
        out.spread(_block_of(want, blocks), blocks, ASK, told.block, want)

    return act


def _tell(told: _Told, out: _Out) -> None:
    """The vectors that other blocks ask for."""
    node, vec, least = told.all(NODE, _I8, _F2, _F4)
    vec = vec.reshape(len(node), -1)
    for block, want in told.each(ASK, _I8):
        at = np.searchsorted(node, want)
        out.put(block, TOLD, told.block, want, vec[at], least[at])


#: Nodes whose partners are measured at once.
_AT_ONCE = 64


def _meet(blocks: int) -> Callable[[_Told, _Out], None]:
    """Those that a node brings together, held against each other: each is told its best partners, if they reach its list."""

    def act(told: _Told, out: _Out) -> None:
        row, met, new = told.all(MET, _I4, _I8, _U1)
        node, vec, least = told.all(TOLD, _I8, _F2, _F4)
        if not len(row):
            return
        order = np.argsort(node)
        node, vec, least = node[order], vec.reshape(len(node), -1)[order], least[order]
        at = np.searchsorted(node, met)
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(head, len(row)))
        found = []
        for lo in range(0, len(head), _AT_ONCE):
            h, n = head[lo : lo + _AT_ONCE], size[lo : lo + _AT_ONCE]
            pick = np.minimum(h[:, None] + np.arange(n.max()), len(row) - 1)
            real = np.arange(n.max()) < n[:, None]
            who = at[pick]
            x = vec[who].astype(_F4)
            s = x @ x.transpose(0, 2, 1)
            fresh = (new[pick] > 0) & real
            ok = real[:, :, None] & real[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (s >= least[who][:, :, None])
            ok[:, np.arange(s.shape[1]), np.arange(s.shape[1])] = False
            s = np.where(ok, s, -np.inf)
            k = min(PARTNERS, s.shape[2])
            top = np.argpartition(-s, k - 1, 2)[:, :, :k]
            s = np.take_along_axis(s, top, 2)
            i, j, l = np.nonzero(s > -np.inf)
            found.append((node[who[i, j]], node[who[i, top[i, j, l]]], s[i, j, l]))
        target, partner, score = (np.concatenate([f[k] for f in found]) for k in range(3))
        out.spread(_block_of(target, blocks), blocks, PUT, told.block, target, partner, score.astype(_F4))

    return act


def _round(state: DataFrame, blocks: int) -> DataFrame:
    """One round of the descent."""
    lists = _kinds(state, LIST, without="b")
    met = materialise(_exchange(lists.unionByName(lists.mapInArrow(_acting(_backward(blocks)), _MESSAGE)), _gather(blocks)))
    told = _exchange(_kinds(state, NODE).unionByName(_kinds(met, ASK)), _tell)
    puts = _exchange(told.unionByName(_kinds(met, MET)), _meet(blocks))
    out = materialise(_exchange(_kinds(state, NODE, LIST).unionByName(puts), _merge))
    discard(met)
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages LIST as rows (node, ids, scores)."""
    for batch in batches:
        for r in range(len(batch)):
            ids, scores, node = (np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in ((3, _I8), (4, _F4), (6, _I8)))
            full = ids >= 0
            yield _lists(node, ids[full], scores[full], np.append(0, np.cumsum(full.reshape(len(node), NEIGHBOURS).sum(1))))


def build_graph(vecs: DataFrame, n: int, dim: int) -> DataFrame:
    """(node, ids, scores): the neighbours of every node (node, vec), best first."""
    leaf = min(LEAF, max(LEAST_LEAF, n // START))
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    planes = np.random.default_rng(17).normal(size=(TREES if depth else 1, depth, dim)).astype(np.float32)
    dealt = vecs.mapInArrow(_leaves(planes), "tree int, leaf long, node long, vec binary")
    size = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * leaf)).cast("int").alias("parts"))
    split = dealt.join(size, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    blocks = math.ceil(n / BLOCK) or 1
    state = materialise(_exchange(_packed(vecs, split.groupBy("tree", "leaf", "part").applyInArrow(_leaf_neighbours, _LISTS), blocks), _merge))
    for _ in range(ITERATIONS):
        old = state
        state = _round(old, blocks)
        discard(old)
        _release(state)
        if _changed(state) < CHANGED:
            break
    return _kinds(state, LIST).mapInArrow(_rows_of, _LISTS)


def _release(df: DataFrame) -> None:
    """Lets Spark's cleaner drop the shuffle files of rounds whose result is written; it waits for the driver's garbage collection."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _pair(row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """64 bits that tell pairs apart."""
    return mix(node.astype(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1)))


def _queries(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Messages QUERY, FOUND and OPEN out of (query, qvec, node, ids, scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for b in batches:
            if len(b):
                query, size = b.column("query").to_numpy(), b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                to, x = _block_of(query, parts), np.frombuffer(b"".join(b.column("qvec").to_pylist()), _F2).reshape(len(b), -1)
                out.spread(to, parts, QUERY, 0, query, x)
                out.spread(to, parts, OPEN, 0, query, b.column("node").to_numpy())
                out.spread(np.repeat(to, size), parts, FOUND, 0, np.repeat(query, size), b.column("ids").flatten().to_numpy().astype(_I8), b.column("scores").flatten().to_numpy().astype(_F4))
                yield from out.batches()
        yield from out.batches(True)

    return run


def _look(blocks: int) -> Callable[[_Told, _Out], None]:
    """A block of queries asks for the neighbours of the nodes that it opens."""

    def act(told: _Told, out: _Out) -> None:
        want = np.unique(told.all(FRONT, _I8, _I8)[1])
        out.spread(_block_of(want, blocks), blocks, LOOK, told.block, want)

    return act


def _near(told: _Told, out: _Out) -> None:
    ids, _, _, node = told.all(LIST, _I8, _F4, _U1, _I8)
    ids = ids.reshape(len(node), NEIGHBOURS)
    for block, want in told.each(LOOK, _I8):
        out.put(block, NEAR, told.block, want, ids[np.searchsorted(node, want)])


def _reach(blocks: int, beam: int) -> Callable[[_Told, _Out], None]:
    """What the opened nodes lead to and a query has not in its list, to be measured where it lies."""

    def act(told: _Told, out: _Out) -> None:
        query, vec = told.all(QUERY, _I8, _F2)
        opens, node = told.all(FRONT, _I8, _I8)
        of, ids = told.all(NEAR, _I8, _I8)
        if not len(opens):
            return
        order = np.argsort(of)
        ids = ids.reshape(len(of), NEIGHBOURS)[order][np.searchsorted(of[order], node)]
        row = np.repeat(np.searchsorted(query, opens).astype(_I4), NEIGHBOURS)[ids.ravel() >= 0]
        ids = ids.ravel()[ids.ravel() >= 0]
        q, held, score = told.all(FOUND, _I8, _I8, _F4)
        oq, opened = told.all(OPEN, _I8, _I8)
        seen = np.concatenate([_pair(np.searchsorted(query, q), held), _pair(np.searchsorted(query, oq), opened)])
        key, first = np.unique(_pair(row, ids), return_index=True)
        first = first[~np.isin(key, seen)]
        row, ids = row[first], ids[first]
        worst, size = np.full(len(query), np.inf, _F4), np.bincount(np.searchsorted(query, q), minlength=len(query))
        np.minimum.at(worst, np.searchsorted(query, q), score)
        worst[size < beam] = -np.inf
        to = _block_of(ids, blocks)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(blocks + 1))
        for k in np.flatnonzero(cut[1:] > cut[:-1]):
            own = order[cut[k] : cut[k + 1]]
            out.put(k, WANT, told.block, row[own], ids[own], vec, worst)

    return act


def _measure(told: _Told, out: _Out) -> None:
    """Scores of the nodes that queries want, where they reach the list's worst."""
    node, vec = told.all(NODE, _I8, _F2)
    x = vec.reshape(len(node), -1).astype(_F4)
    for block, row, ids, q, worst in told.each(WANT, _I4, _I8, _F2, _F4):
        q, at = q.reshape(len(worst), -1).astype(_F4), np.searchsorted(node, ids)
        s = np.concatenate([np.einsum("ij,ij->i", x[at[lo : lo + (1 << 14)]], q[row[lo : lo + (1 << 14)]]) for lo in range(0, len(at), 1 << 14)])
        ok = s >= worst[row]
        out.put(block, SCORED, told.block, row[ok], ids[ok], s[ok])


def _advance(beam: int, opened: int) -> Callable[[_Told, _Out], None]:
    """What was measured is merged into the queries' lists; the best nodes that are not opened yet are the next to be."""

    def act(told: _Told, out: _Out) -> None:
        query, vec = told.all(QUERY, _I8, _F2)
        order = np.argsort(query)
        query, vec = query[order], vec.reshape(len(query), -1)[order]
        q, ids, scores = told.all(FOUND, _I8, _I8, _F4)
        row, more, s = told.all(SCORED, _I4, _I8, _F4)
        row, ids, scores = np.concatenate([np.searchsorted(query, q), row]), np.concatenate([ids, more]), np.concatenate([scores, s])
        o = _best(row, ids, scores, beam)
        row, ids, scores = row[o], ids[o], scores[o]
        oq, node = (np.concatenate([a, b]) for a, b in zip(told.all(OPEN, _I8, _I8), told.all(FRONT, _I8, _I8), strict=True))
        first = (np.arange(len(row)) - np.searchsorted(row, row) < opened) & ~np.isin(_pair(row, ids), _pair(np.searchsorted(query, oq), node))
        out.put(told.block, QUERY, 0, query, vec)
        out.put(told.block, FOUND, 0, query[row], ids, scores)
        out.put(told.block, OPEN, len(oq), oq, node)
        if first.any():
            out.put(told.block, FRONT, int(first.sum()), query[row[first]], ids[first])

    return act


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages FOUND as rows (query, ids)."""
    for batch in batches:
        for r in range(len(batch)):
            query, ids = (np.frombuffer(batch.column(k)[r].as_buffer(), _I8) for k in (3, 4))
            head = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
            yield pa.RecordBatch.from_arrays([pa.array(query[head]), pa.ListArray.from_arrays(pa.array(np.append(head, len(query)).astype(np.int32)), pa.array(ids))], ["query", "ids"])


def _recall(found: DataFrame, truth: DataFrame) -> float:
    met = F.size(F.array_intersect("ids", "best")) / F.size("best")
    return float(found.join(F.broadcast(truth), "query").agg(F.avg(met)).first()[0] or 0.0)


def search(graph: DataFrame, vecs: DataFrame, queries: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(query, ids): the nodes that greedy search from each query (query, qvec, its own node) ends with, best first.

    A walk ends when the best nodes of its list are all opened; each round opens what is new among them.  truth:
    (query, best) of some queries; while they have less than RECALL of it, lists are doubled and the walks go on, until
    everything a walk can reach is opened.
    """
    blocks, parts = math.ceil(vecs.count() / BLOCK) or 1, math.ceil(queries.count() / ASKING) or 1
    nodes = materialise(_exchange(_packed(vecs, graph, blocks), _merge))
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    start = queries.join(graph, "node", "left").select("query", "qvec", "node", empty("ids", "long"), empty("scores", "float"))
    beam, opened, met = BEAM, OPENED, 0
    state = materialise(_exchange(start.mapInArrow(_queries(parts), _MESSAGE), _advance(beam, opened)))
    while True:
        n = {r.kind: r.s for r in state.groupBy("kind").agg(F.sum("n").alias("s")).collect()}
        old = state
        if not n.get(FRONT):
            found = _kinds(state, FOUND).mapInArrow(_walks, "query long, ids array<long>")
            held, recall = n.get(OPEN, 0), 1.0 if truth is None else _recall(found, truth)
            if recall < RECALL and held == met:
                warnings.warn(f"walks have opened all they reach, with a recall of {recall:.3f} and not {RECALL}", stacklevel=2)
            if recall >= RECALL or held == met:
                discard(nodes)
                return found
            met, beam, opened = held, 2 * beam, 2 * opened  # wider lists that open nothing more are the end
            state = materialise(_exchange(old, _advance(beam, opened)))
        else:
            near = _exchange(_kinds(nodes, LIST, without="b").unionByName(_kinds(state, FRONT).mapInArrow(_acting(_look(blocks)), _MESSAGE)), _near)
            want = _exchange(state.unionByName(near), _reach(blocks, beam))
            state = materialise(_exchange(old.unionByName(_exchange(_kinds(nodes, NODE).unionByName(want), _measure)), _advance(beam, opened)))
        discard(old)
        _release(state)


def exact_neighbours(nodes: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query, best): the k best other nodes (node, v) of each given query (node, vector), by measuring all of them."""
    q_id, q = np.array([a for a, _ in asked], np.int64), np.array([v for _, v in asked], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            col, node = b.column("v"), b.column("node").to_numpy()
            s = q @ col.flatten().to_numpy().reshape(len(b), q.shape[1]).T
            s[q_id[:, None] == node[None]] = -np.inf
            ids, scores = _best_rows(node, s, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], ["query", "node", "score"])

    found = nodes.select("node", "v").mapInArrow(run, "query long, node long, score double").where(F.col("score") != F.lit(float("-inf")))
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return found.withColumn("_r", turn).where(F.col("_r") <= k).groupBy("query").agg(F.collect_list("node").alias("best"))


def nearest(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best partners found of each row whose vec_id is divisible by ``every``.

    Score: inner product in double precision; ties go to the smaller vec_id.  Every row is a candidate for every query but
    itself, rows that repeat a vec_id or a vector included; a query whose vec_id repeats has k partners for each of its rows.
    Rows whose vector is null, zero or holds null or non-finite components take no part, nor do rows without a vec_id or of
    another length than most.  Other columns are ignored.  Equal vectors are one node of the graph.
    """
    spark = table.sparkSession
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _finite(F.col("v")))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sizes[0].d)
    v = materialise(v.where(F.size("v") == dim).withColumn("rid", F.monotonically_increasing_id()))
    nodes = materialise(v.groupBy("v").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")))

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(len(b), dim)
            top = np.abs(x).max() if len(b) else 1.0
            x = x / scale if top <= scale * 6e4 else x / top
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["node", "vec"])

    scale = float(nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0)
    vecs = materialise(nodes.select("node", "v").mapInArrow(half, "node long, vec binary"))
    graph = build_graph(vecs, vecs.count(), dim)
    own = materialise(join_counted(v, nodes, "v", "n").select("rid", "vec_id", "node"))
    asked = own.where(F.col("vec_id") % every == 0)
    asked_nodes = materialise(asked.select("node").distinct())
    walks = asked_nodes.join(vecs, "node").select(F.col("node").alias("query"), F.col("vec").alias("qvec"), "node")
    sample = asked_nodes.orderBy(F.xxhash64("node"), "node").limit(MEASURED).join(nodes, "node").select("node", "v").collect()
    truth = materialise(exact_neighbours(nodes, [(r.node, r.v) for r in sample], k)) if sample else None
    found = search(graph, vecs, walks, truth)
    # Every query's own node counts too: rows that hold the same vector are its partners.
    pairs = found.select(F.col("query").alias("qn"), F.explode("ids").alias("node")).unionByName(asked_nodes.select(F.col("node").alias("qn"), "node")).distinct()
    exact = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(nodes.select(F.col("node").alias("qn"), F.col("v").alias("qv")), "qn").join(nodes.select("node", "v"), "node").select("qn", "node", exact(F.col("qv"), F.col("v")).alias("score"))
    # A node stands for one row or more, so the k + 1 best nodes hold the k best rows; of one node its k + 1 least vec_ids.
    scored = scored.withColumn("_r", F.rank().over(Window.partitionBy("qn").orderBy(F.desc("score")))).where(F.col("_r") <= k + 1).drop("_r")
    least = own.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "rid"))).where(F.col("_r") <= k + 1).select("vec_id", "node", "rid")
    rows = scored.join(asked.select(F.col("rid").alias("qr"), F.col("vec_id").alias("query_id"), F.col("node").alias("qn")), "qn").join(least, "node").where("qr <> rid")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qr").orderBy(F.desc("score"), "vec_id", "rid")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["build_graph", "exact_neighbours", "nearest", "search"]
