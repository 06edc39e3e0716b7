"""Hard negatives against brute force: odd rows, ties, hot vectors, pruned trees."""

import os

import duckdb
import numpy as np
import pytest

from pointengine.llm import dual_tree
from pointengine.llm import queries as llm

SCHEMA = "vec_id long, embedding array<float>, label int, pos string, block int, n int"  # columns that clash with the operator's own


def brute(rows):
    """Rows (vec_id, embedding, label) to result rows, by sorting everything for every anchor."""
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float)), (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, x, y in rows if y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max((len(x) for _, x, _ in good), default=0)
    v = np.array([np.pad(x, (0, width - len(x))) for _, x, _ in good]).reshape(len(good), width)
    out = []
    for k, (i, _, y) in enumerate(good):
        if i is None or i % 100:
            continue
        score = (v.astype(np.int64) @ v[k].astype(np.int64)).tolist()
        order = sorted((j for j in range(len(good)) if j != k), key=lambda j: (-score[j], good[j][0] is None, good[j][0] or 0))
        for p in [j for j in order if good[j][2] == y][:5]:
            ps = score[p]
            found = [j for j in order if good[j][2] != y and 30 * ps <= 100 * score[j] <= 90 * ps][:10]
            out += [(i, good[p][0], r + 1, good[j][0], ps, score[j]) for r, j in enumerate(found)]
    return sorted(out, key=str)


def mined(spark, rows, **k):
    df = spark.createDataFrame([(i, None if x is None else [c if c is None else float(c) for c in x], y, "p", 1, 2) for i, x, y in rows], SCHEMA)
    return sorted(map(tuple, dual_tree.hard_negatives(df, **k).collect()), key=str)


def clustered(n, groups=12, width=8, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    g = rng.integers(0, groups, n)
    x = centres[g] + spread * rng.normal(size=(n, width))
    return [(int(i), x[i].astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]


def test_random_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.normal(size=16) / 4).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(1200)]
    assert mined(spark, rows) == brute(rows) != []


def test_many_leaves_and_blocks(spark, monkeypatch):
    for name, v in dict(ANCHOR_BLOCK=8, CANDIDATE_BLOCK=64, ANCHOR_RUN=2, CANDIDATE_RUN=8, DEALT_ROWS=100, DEALT_BLOCKS=3).items():
        monkeypatch.setattr(dual_tree, name, v)
    rows = clustered(3000)
    rows += [(100 * k, rows[100][1], 3) for k in range(40, 45)] + [(9000 + k, rows[100][1], k % 10) for k in range(600)]  # a hot vector
    want = brute(rows)
    assert mined(spark, rows) == want != []


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda: rng.integers(-3, 4, 4).astype(float) / 4
    rows = [(int(i), v().tolist(), int(rng.integers(0, 3))) for i in range(-200, 300)]
    rows += [(None, [0.5, 0.5, 0.25, 0.0], 1), (None, [0.5, 0.5, 0.25, 0.0], 2), (100, None, 1), (200, [0.5, None, 0.0, 1.0], 1), (300, [float("nan")] * 4, 1), (400, [float("inf"), 0, 0, 0], 0), (500, [0.5, 0.5, 0.5, 0.5], None)]
    rows += [(100, rows[7][1], 1), (100, rows[7][1], 1), (600, [1.0, 0.5], 2), (601, [], 1), (700, [], 2), (800, [0.0] * 4, 1)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == [] == mined(spark, [(1, [1.0], 2)]) == mined(spark, [(100, [1.0], 2)])


def test_large_components(spark):
    """Beyond what doubles add up exactly; what does not fit is held."""
    rows = [(i, [130000.0 - 997 * (i % 89)] * 8 + [-3.0 * i], i % 2) for i in range(0, 400, 5)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, [(100, [3e38], 1), (102, [3e38], 1), (101, [0.001], 2), (104, [50000.0], 2)])[0][4] == dual_tree.HELD**2


def test_other_parameters(spark):
    rows = clustered(500, seed=4)
    a = mined(spark, rows, every=50, flipped=10**9)
    assert {r[0] for r in a} <= {i for i in range(0, 500, 50)} and len({r[0] for r in a}) > 5


def test_nodes_are_pruned():
    """Groups of vectors: most pairs are never scored, and the search gives what scoring all would give."""
    rows = clustered(4096, groups=40, width=16)
    rng = np.random.default_rng(0)
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int32)
    y = rng.integers(0, 10, len(x)).astype(np.int32)

    def block(idx, run):
        parts = []
        dual_tree._ordered(x, np.array(idx), run, parts)
        i = np.concatenate(parts)
        raw = {"n": len(i), "runs": np.cumsum([0, *map(len, parts[:-1])]).astype(np.int32).tobytes(), "ids": i.astype(np.int64).tobytes(), "nulls": bytes(len(i)), "labels": y[i].tobytes(), "rows": i.astype(np.int64).tobytes(), "vectors": x[i].tobytes()}
        return dual_tree.Block(raw, x.shape[1])

    a, c = block(range(0, 4096, 8), 16), block(range(4096), 32)
    s = dual_tree.Search(a, True, np.full((a.n, 1), dual_tree._LOW), np.full((a.n, 1), dual_tree._HIGH), 5)
    s.meet(c)
    assert s.scored < 0.25 * a.n * c.n
    t = s.rows(0).to_pylist()
    v = x.astype(np.int64)
    for pos in range(0, a.n, 37):
        i = int(a.ids[pos])
        score = v @ v[i]
        want = sorted((-int(score[j]), j) for j in range(len(x)) if j != i and y[j] == y[i])[:5]
        assert sorted((-r["score"], r["vec_id"]) for r in t if r["pos"] == pos) == want


def test_intervals_hold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, c = rng.normal(size=(30, 6)) * 100 + rng.normal(size=6) * 300, rng.normal(size=(40, 6)) * 100 + rng.normal(size=6) * 300
        ball = lambda z: (z.mean(0)[None], np.array([np.sqrt(((z - z.mean(0)) ** 2).sum(1)).max()]), np.array([np.sqrt((z**2).sum(1)).max()]))
        lo, hi = dual_tree.intervals(*ball(a), *ball(c))
        assert lo[0, 0] <= (a @ c.T).min() and hi[0, 0] >= (a @ c.T).max()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("name", ["op8_packing", "op11_fill_middle", "op12_dual_tree"])
def test_twins(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, want = llm.QUERIES[name](spark, sf).toPandas(), con.execute(llm.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(mine.columns) == cols
    a, b = (x[cols].astype(object).where(x[cols].notna(), None).values.tolist() for x in (mine, want))
    assert sorted(a, key=str) == sorted(b, key=str) and a
