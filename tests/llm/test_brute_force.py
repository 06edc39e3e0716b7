"""Methods against brute force, and odd inputs of the operators and of every stage of the pipeline."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from pointengine.llm import ctw, line_crf, near_dedup, nn_descent, piece_scan, quality_pu, sampling, sharding, suffix_dedup, toxicity_fm
from pointengine.llm.textbytes import Chunk

WORDS = "amber birch cedar delta ember fjord grove haven inlet juniper kelp lagoon meadow nectar orchid".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def chunk(*texts):
    b = [t.encode() for t in texts]
    return Chunk(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]))


# ------------------------------------------------------------------------------------------------ near duplicates


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(21)
    base = [text(rng, rng.randrange(40, 200)) for _ in range(40)]
    texts = base + [edited(rng, t, rng.randrange(1, 9)) for t in base for _ in range(3)] + ["a b", "a b", "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.shingle_weights(docs)
    weigh = []
    for t in texts:
        _, h, times = near_dedup.shingles(chunk(t))
        words = t.split()
        grams = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
        assert sorted(times.tolist()) == sorted(grams.values())
        weigh.append(dict(zip(h.tolist(), near_dedup._weights(h, times, idf).astype(float).tolist())))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            least = sum(min(w, weigh[j].get(h, 0.0)) for h, w in weigh[i].items())
            sim = least / max(sum(weigh[i].values()) + sum(weigh[j].values()) - least, 1e-12)
            close += 0.6 < sim < 0.8
            if sim >= 0.8 or texts[i] == texts[j]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = {i: root(i) for i in range(len(texts))}
    assert close > 5 and len(set(want.values())) < len(texts) - 20
    for agree in (near_dedup.AGREE, 0):
        got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs, agree).collect()}
        assert {i: c for i, (c, _) in got.items()} == want
        assert all(n == Counter(want.values())[c] for c, n in got.values())


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(3)
    idf = np.ones((near_dedup.SKETCH_ROWS, near_dedup.BUCKETS), np.float32)
    off = []
    for n in (2, 6, 12, 20, 30):
        for _ in range(6):
            a = text(rng, 160)
            b = edited(rng, a, n)
            sig = []
            for t in (a, b):
                of, h, times = near_dedup.shingles(chunk(t))
                sig.append(near_dedup.samples(of, h, near_dedup._weights(h, times, idf))[1][0])
            off.append((sig[0] == sig[1]).mean() - near_dedup.weighted_jaccard(chunk(a), chunk(b), idf)[0])
    assert abs(np.mean(off)) < 0.03 and max(map(abs, off)) < 0.25


def test_frequent_shingles_weigh_less_at_any_size():
    rng = np.random.default_rng(5)
    for mean in (3, 300):
        counts = rng.poisson(mean, (2, 4096))
        counts[:, 7] += 5000
        idf = near_dedup.damped_idf(counts, 10000)
        assert (idf[:, np.arange(4096) != 7] == 1.5).mean() > 0.99 and (idf[:, 7] < 1.1).all()


# ------------------------------------------------------------------------------------------------------ learners


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(8)
    m = toxicity_fm.Machine(np.arange(12, dtype=np.uint64), 0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    sets = [[], [3], [0, 5, 7], list(range(12))]
    want = [0.3 + sum(m.weights[i] for i in s) + sum(m.factors[i] @ m.factors[j] for i in s for j in s if i < j) for s in sets]
    t = np.repeat(np.arange(4), [len(s) for s in sets])
    assert m.logits(t, np.array([i for s in sets for i in s]), 4) == pytest.approx(want)


@pytest.mark.parametrize("prior", [None, 0.2, 0.9])
def test_risk_and_its_gradient(prior):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 5))
    x[:10] += 1
    parts = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    value, grads, rest = quality_pu.risk(parts, x, 10, prior)
    z = np.tanh(x @ parts[0] + parts[1]) @ parts[2] + parts[3]
    loss = lambda s: np.log1p(np.exp(-s))
    plus, minus_p, minus_u = loss(z[:10]).mean(), loss(-z[:10]).mean(), loss(-z[10:]).mean()
    assert value == pytest.approx(plus + minus_u if prior is None else prior * plus + max(0, minus_u - prior * minus_p))
    back = prior is not None and rest < 0

    def goal():
        v, _, r = quality_pu.risk(parts, x, 10, prior)
        return -r if back else v

    for p, g in zip(parts, grads):
        for at in list(np.ndindex(p.shape))[:6]:
            p[at] += 1e-6
            up = goal()
            p[at] -= 2e-6
            down = goal()
            p[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_lines_of_one_text_get_different_labels():
    rng = np.random.default_rng(10)
    kind = np.array([[1, 1, 1, 1, -1, -1, 1, 1, 1, 1]] * 60 + [[-1] * 10] * 60)
    x = kind[:, :, None] + rng.normal(0, 0.3, (120, 10, 1))
    f = line_crf.fit_field(x, np.ones((120, 10), bool), np.repeat([1, 0], 60))
    y = line_crf.viterbi(line_crf.LineField(f.weights, f.start, f.move), x.reshape(-1, 1), np.repeat(np.arange(120), 10)).reshape(120, 10)
    assert (y[:60] == (kind[:60] > 0)).mean() > 0.95 and y[60:].mean() < 0.05


def test_rules_report_repeated_lines_and_verdicts(spark):
    rng = random.Random(4)
    good = "\n".join(text(rng, 12) for _ in range(10))
    texts = [good, good + "\n" + good.split("\n")[0] + "\n\n\n", "x\nx\n x\nx", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_crf.rule_documents(docs, line_crf.LineField.plain()).collect()}
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].kept == (not got[i].base_failed)
    assert [got[i].kept for i in range(4)] == [True, True, False, False]


def test_a_repeated_id_is_one_sample_row(spark):
    docs = spark.createDataFrame([(1, "b", 0), (1, "a", 0), (2, "c", 0), (None, "d", 0)], "doc_id long, text string, y int")
    ids = spark.createDataFrame([(1, 1), (1, -1), (2, 1)], "doc_id long, y int")
    assert sorted(map(tuple, sampling.with_text(docs, ids).collect())) == [(1, "a", -1), (1, "a", 1), (2, "c", 1)] or sorted((r.doc_id, r.text, r.y) for r in sampling.with_text(docs, ids).collect()) == [(1, "a", -1), (1, "a", 1), (2, "c", 1)]


def test_contradicting_and_null_labels(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    of = lambda v: {r.doc_id for r in sampling.labelled(labels, "quality", v, 10).collect()}
    train = {i for i in (1, 2, 4) if zlib.crc32(str(i).encode()) % 5}
    assert of(1) == {1} & train and of(0) == {4} & train


# ------------------------------------------------------------------------------------------------------- shards


def _descend(key, node):
    while node.shard is None:
        draws = []
        for i, c in enumerate(node.children):
            h = xxhash.xxh64(c.name.encode(), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
            draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / c.weight, i))
        node = node.children[min(draws)[1]]
    return node.shard


def _weighed(node, weights):
    return sharding.Node(node.name, tuple(_weighed(c, weights) for c in node.children), node.shard, weights.get(node.shard, 1.0))


def test_descent_of_unequal_weights(spark):
    tree = _weighed(sharding.topology(), {3: 4.0, 9: 0.25, 14: 2.5})
    docs = spark.range(3000).selectExpr("id - 5 as doc_id", "'t' as text")
    got = {r.doc_id: r for r in sharding.shard_documents(docs, tree).collect()}
    assert all(r.shard == _descend(i, tree) and r.grown_shard == _descend(i, sharding.grown(tree, 16)) for i, r in got.items())
    share = Counter(r.shard for r in got.values())
    assert abs(share[3] / 3000 - 4.0 / 19.75) < 0.04 and share[9] < share[8]


def test_a_changed_weight_moves_rows_into_its_subtree_only(spark):
    old, new = sharding.topology(), _weighed(sharding.topology(), {5: 3.0})  # region 1, rack 0 of it, its second shard
    docs = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    of = lambda tree: {r.doc_id: r.shard for r in sharding.shard_documents(docs, tree).select("doc_id", "shard").collect()}
    a, b = of(old), of(new)
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved
    for x, y in moved:
        assert y // 4 == 1  # into the region
        if x // 4 == 1:
            assert y // 2 == 2  # within it into the rack
            if x // 2 == 2:
                assert y == 5


# -------------------------------------------------------------------------------------------------- base scores


def test_base_score_is_the_count_model(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, rng.randrange(0, 30)).title()) for i in range(40)] + [(50, None), (51, "only here zzz")]
    got = {r.doc_id: r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), None])
    total = sum(c.values())
    for i, t in rows:
        tokens = [*words(t), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in tokens))


# ------------------------------------------------------------------------------------------------------- pieces


def vocabulary():
    rng = random.Random(12)
    words = sorted({("" if rng.random() < 0.5 else " ") + rng.choice(WORDS)[: rng.randrange(1, 7)] for _ in range(300)} | {"  ", "1", "2", "12", "é"})
    pieces = [bytes([i]) for i in range(256)] + [w.encode() for w in words]
    scores = np.concatenate([np.full(256, -30.0), -np.round(np.array([rng.uniform(3, 12) for _ in words]))])  # whole numbers: many ties
    return piece_scan.Vocabulary(tuple(pieces), scores, np.arange(256), -30.0)


def test_scan_gives_the_ids_of_the_word_path():
    v = vocabulary()
    lat = piece_scan.Lattice(v)
    rng = random.Random(13)
    t = " ".join(rng.choice(("", "  ", "é")) + rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(116_000))
    assert len(t) > 1_000_000
    words, a = piece_scan.encode_chunk(lat, chunk(t))
    scan, b = piece_scan.encode_chunk(lat, chunk(t), giant=0)
    assert words[0].tolist() == scan[0].tolist() and a[0] == b[0]
    assert lat.decode(scan[0])[1:] == t.encode()


def test_dealt_chunks_give_the_same_ids(spark, monkeypatch):
    monkeypatch.setattr(piece_scan, "DEALT", 2048)
    v = vocabulary()
    rng = random.Random(14)
    rows = [(i, text(rng, n)) for i, n in enumerate((900, 3, 700, 1200))] + [(4, None), (None, text(rng, 800)), (6, ""), (7, "q" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{str(r.doc_id): (list(r.ids), r.score) for r in piece_scan.encode(docs, v, giant).collect()} for giant in (4000, 1 << 40)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all(r.round_trip for r in piece_scan.digest(docs, v, 4000).collect())
    assert piece_scan.digest(docs.limit(0), v).count() == 0


# --------------------------------------------------------------------------------------- classifiers, held out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("model,name", [(toxicity_fm, "toxic"), (quality_pu, "quality")])
def test_held_out_labels(spark, model, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = model.score_documents(docs, model.fit(docs, labels)).where("held_out").join(labels.selectExpr("doc_id", f"CAST({name} AS int) AS y"), "doc_id").where("y IS NOT NULL").toPandas()
    good, bad = (got.score[got.y == k].to_numpy() for k in (1, 0))
    assert len(good) and len(bad)
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.9  # area under the curve


# -------------------------------------------------------------------------------------------- repeated passages


def _want(rows):
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                cov[k : k + 50] = True
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out.append((str(i), len(b), int(cov.sum()), int((cov & ~np.append(False, cov[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_far_ids_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", 4)
    rng = random.Random(15)
    passage = text(rng, 40)
    ids = [(1 << 46) - 1, (1 << 48) + 5, -3, None, (1 << 62) + 1, 7, 7, None, *range(20, 50)]
    rows = [(i, text(rng, 20) + " " + passage + " " + text(rng, 20)) for i in ids] + [(60, passage), (61, passage), (62, passage + "x"), (63, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_documents(docs).collect())
    assert got == _want(rows)


def test_copies_are_settled_by_arrays_too(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMMON_TEXTS", 1)  # as in a table so large that no text is among the commonest
    rng = random.Random(26)
    rows = [(i, text(rng, 40)) for i in range(6)]
    rows += [(10 + i, t) for i, t in rows] + [(20, rows[0][1]), (20, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_documents(docs).collect())
    assert got == _want(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_sides_of_hot_anchors(spark, monkeypatch, parts):
    monkeypatch.setattr(suffix_dedup, "TOLD", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_TOLD", 2)
    rng = random.Random(25)
    passage, line = text(rng, 60), text(rng, 8)
    rows = [(i, text(rng, 15) + " " + (passage[i:] if i % 3 else line) + " " + text(rng, 15)) for i in range(40)]
    rows += [(None, passage), (3, line * 3), (50, line), (51, passage[:49]), (52, passage[7:57]), (None, line + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert len(suffix_dedup._hot_anchors(docs.selectExpr("coalesce(doc_id, -1L) AS doc", "xxhash64(text) AS h", "text"))) > 5
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_documents(docs).collect())
    assert got == _want(rows)


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_a_task_passes_on_few_sides_of_a_hot_anchor(monkeypatch, held):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rng = random.Random(27)
    passage = text(rng, 30)
    texts = [text(rng, 5) + " " + passage + " " + text(rng, 5) for _ in range(200)]
    hot = np.unique(suffix_dedup.fragments(chunk(passage))[0])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 20)), pa.array(range(i, i + 20)), pa.array(texts[i : i + 20])], ["doc", "h", "text"]) for i in range(0, 200, 20)]
    out = pa.Table.from_batches(list(suffix_dedup._anchors(3, 2, hot)(iter(batches))))
    on = suffix_dedup._unpack([b for b, n in zip(out.column("entries").to_pylist(), out.column("shard").to_pylist(), strict=True) if n >= 0])
    a = suffix_dedup._unpack(out.filter(pc.less(out.column("shard"), 0)).column("entries").to_pylist())[0]
    inner = [x for x in hot if (a == x).sum() >= 200]
    assert inner
    if held == 1 << 20:  # one least and one largest document a side; sides that one text alone has go on
        sides = Counter((x, l, r) for x, l, r in zip(on[0].tolist(), on[5].tolist(), on[6].tolist(), strict=True) if x in set(hot.tolist()))
        assert max(sides.values()) == 2


def test_kept_passages_keep_any_column(spark):
    rng = random.Random(16)
    passage = text(rng, 30)
    names = ["uid", "_removed", "_kept", "_id", "row", "doc", "h", "key", "runs", "copy", "n_bytes", "a"]
    rows = [(i, text(rng, 9) + "\n" + passage, *[k for k in range(len(names))]) for i in (5, 6, None)] + [(8, passage, *[k for k in range(len(names))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = suffix_dedup.kept_documents(docs)
    out = got.collect()
    assert got.columns == docs.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in out)
    assert {r.doc_id for r in out} == {5, 6, None}  # all of 8 stands in 5
    assert next(r.text for r in out if r.doc_id == 5) == rows[0][1] and passage not in next(r.text for r in out if r.doc_id == 6)


# --------------------------------------------------------------------------------------------------- neighbours


def test_rows_that_share_an_id_or_a_vector(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, (x[20] + 1).tolist()), (21, x[5].tolist()), (5, x[5].tolist())]
    got = {}
    for r in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((round(r.score, 4), r.vec_id))
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    met = total = 0
    for q in range(0, 300, 20):
        want = []
        for at in np.flatnonzero(ids == q):
            s = m @ m[at]
            best = sorted((i for i in range(len(rows)) if i != at), key=lambda i: (-s[i], ids[i]))[:20]
            want += [(round(s[i], 4), ids[i]) for i in best]
        met += sum((Counter(want) & Counter(got[q])).values())
        total += len(want)
        assert len(got[q]) == len(want)
    assert met / total >= 0.9


def test_exact_neighbours(spark):
    x = np.random.default_rng(18).normal(size=(90, 6))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    got = {r.query: set(r.best) for r in nn_descent.exact_neighbours(nodes, [(3, x[3].tolist()), (40, x[40].tolist())], 7).collect()}
    for q in (3, 40):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == set(np.argsort(-s)[:7].tolist())


# ----------------------------------------------------------------------------------------------------- pipeline


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_every_stage_takes_odd_tables(spark, tmp_path, case):
    import corpus_pipeline

    rng = random.Random(19)
    texts = ["\n".join(text(rng, 8).capitalize() + "." for _ in range(12)) for _ in range(12)]
    rows = [] if case == "empty" else [(i, t, "en", 1, 2) for i, t in enumerate(texts)] + [(None, texts[0], "en", 1, 2), (None, None, None, None, None), (3, texts[3], "en", 1, 2), (3, "", "xx", 0, 0), (99, text(rng, 20000), "en", 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, node int, _row int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(100)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert got.count() <= len(rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) <= len(rows) and (case == "odd") == bool(out)
