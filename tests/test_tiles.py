"""Sums and pairs in tiles against joins, and a sorted cut against a limit."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import predictors as L
from weftgraph.operators import splits as U
from weftgraph.operators import tiles as I
from weftgraph.operators.order import first_rows


@pytest.fixture
def few(monkeypatch):
    """Several blocks on small graphs."""
    monkeypatch.setattr(I, "FEW", 10)
    monkeypatch.setattr(I, "PIECE", 64)


def graph(spark, n=60, m=700, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    rows = [(int(a), int(b), float(w), int(k)) for a, b, w, k in zip(rng.integers(n + 5, size=m), rng.integers(n + 5, size=m), rng.random(m) + 0.1, rng.integers(2, size=m))]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "node_id long, feature array<double>")
    return nodes, spark.createDataFrame(rows, "src long, dst long, w double, k int"), x, rows


def test_first_rows_are_those_of_a_limit(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), "id").repartition(7)
    for n in (0, 1, 333, 1000, 2000):
        assert [r.a for r in first_rows(rows, n, F.desc("a")).orderBy(F.desc("a")).collect()] == list(range(999, max(-1, 999 - n), -1))


def test_negatives_pass_no_single_task(spark):
    """A sort and a limit wrote all kept pairs by one task."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    found = U.random_negatives(edges, 400, 20_000, 3)
    assert len(found.inputFiles()) > 1
    assert found.count() == 20_000 == found.distinct().count()


def test_products_of_pairs(spark, few, monkeypatch):
    nodes, edges, x, rows = graph(spark)
    pairs = edges.select("src", "dst", F.col("k").alias("y"))
    want = sorted((s, d, k, *np.round(x[s] * x[d], 9)) for s, d, _, k in rows if s < 60 and d < 60)
    monkeypatch.setattr(I, "PAIRS", 40)
    assert sorted((r.src, r.dst, r.y, *np.round(r.feature, 9)) for r in L.pair_features(pairs, nodes).collect()) == want
    p = {(r.src, r.dst): r.p for r in L.dot_scores(pairs, nodes).collect()}
    assert all(abs(p[s, d] - 1 / (1 + np.exp(-x[s] @ x[d]))) < 1e-12 for s, d, *_ in want)


@pytest.mark.parametrize("back", [False, True])
def test_sums(spark, few, back):
    """Weighted sums over several tiles; ends without a vector do not count."""
    nodes, edges, x, rows = graph(spark)
    tiles = I.Tiles(edges)
    assert tiles.blocks == I.BLOCKS and tiles.packed.count() == I.BLOCKS**2
    want, kinds = {}, {}
    for s, d, w, k in rows:
        a, b = (d, s) if back else (s, d)
        if a < 60:
            want[b] = want.get(b, 0) + w * x[a]
            if not back:
                kinds.setdefault(b, np.zeros((2, 3)))[k] += w * x[a]
    found = {r.node_id: r.feature for r in tiles.sums(nodes, back).collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[i], want[i]) for i in want)
    if not back:
        found = {r.node_id: r.feature for r in tiles.sums_by_kind(nodes, 2).collect()}
        assert found.keys() == kinds.keys() and all(np.allclose(found[i], kinds[i].ravel()) for i in kinds)


def test_groups_need_no_partial_sums(spark, few):
    edges = spark.createDataFrame([(10 * g + i, 10 * g) for g in range(30) for i in range(1, 10)], "src long, dst long")
    nodes = spark.range(300).select(F.col("id").alias("node_id"), F.array(F.col("id").cast("double")).alias("feature"))
    tiles = I.Tiles(edges, stride=10)
    assert tiles.packed.where("i <> j").count() == 0
    assert {r.node_id: r.feature[0] for r in tiles.sums(nodes).collect()} == {10 * g: sum(10 * g + i for i in range(1, 10)) for g in range(30)}


def test_attention_of_large_products(spark, few):
    """A softmax over tiles whose greatest products are far apart."""
    from weftgraph.operators import propagate as P

    nodes, edges, x, rows = graph(spark)
    x = x * 30
    big = nodes.select("node_id", F.transform("feature", lambda v: v * 30).alias("feature"))
    found = {r.node_id: r.feature for r in P.attention_arrays(edges.select("src", "dst"), big).collect()}
    for d in range(60):
        near = [s for s, b, *_ in rows if b == d and s < 60]
        e = np.array([x[s] @ x[d] for s in near])
        soft = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert np.allclose(found[d], soft @ x[near], atol=1e-9)


def test_row_model_is_that_of_the_decisions(spark):
    """Counted beside the entries, also where a row spans batches, the model is that of the listed decisions."""
    from weftgraph.operators import generators as G
    from weftgraph.operators import trees as T

    rng = np.random.default_rng(2)
    entries = spark.createDataFrame(sorted({(int(r), int(c)) for r in rng.integers(1, 200, 900) for c in rng.integers(0, r, 1)}), "row_id long, col_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = sorted(map(tuple, G.row_tree_model_of(entries).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted(map(tuple, G.row_tree_model(T.row_decisions(entries)).collect()))


def test_rows_are_drawn_without_a_table_for_each_level(spark, monkeypatch):
    from weftgraph.operators import generators as G

    written = []
    monkeypatch.setattr(G, "materialize", lambda df, name, real=G.materialize: written.append(name) or real(df, name))
    model = spark.createDataFrame([(k, 0.6, 0.5) for k in range(8)], "size_class int, p_left double, p_right double")
    found = G.generate_rows(model, spark.range(1, 200).withColumnRenamed("id", "row_id"), 3)
    assert found.count() == found.distinct().count() and found.where("col_id >= row_id").isEmpty()
    assert found.select("row_id").distinct().count() == 199 and len(written) == 2


def test_trials_lie_in_many_tasks(spark):
    """Full-batch Adam over all tasks gives what one task's NumPy gave; no group holds a trial."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(120, 2)), rng.integers(0, 2, 120)
    role = np.array(["train", "val", "test", "train"])[np.arange(120) % 4]
    rows = spark.createDataFrame([(t, i, [float(v) for v in x[i]], int(y[i]), str(role[i])) for t in range(2) for i in range(120)], "trial int, node_id long, feature array<double>, y int, role string")
    found = L.train_trials(rows, hidden=3, epochs=4, patience=9)
    got = {(r.trial, r.node_id): r.p for r in found.collect()}
    assert len(found.inputFiles()) > 2
    tr, va, te = (role == r for r in ("train", "val", "test"))
    z = (x - x[tr].mean(0)) / (x[tr].std(0) + 1e-8)
    w = np.where(y == 1, (1 - y[tr]).sum() / y[tr].sum(), 1.0)
    for t in range(2):
        g = np.random.default_rng(3407 + t)
        par = [g.normal(0, 1, (2, 3)), np.zeros(3), g.normal(0, np.sqrt(1 / 3), 3), np.zeros(1)]
        m, v, best = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par], (np.inf, None)
        run = lambda p, at: ((h := np.maximum(z[at] @ p[0] + p[1], 0)), 1 / (1 + np.exp(-(h @ p[2] + p[3]))))
        for k in range(1, 5):
            h, q = run(par, tr)
            e = (q - y[tr]) * w[tr] / tr.sum()
            back = np.outer(e, par[2]) * (h > 0)
            for i, d in enumerate((z[tr].T @ back, back.sum(0), h.T @ e, np.array([e.sum()]))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                par[i] = par[i] - 0.05 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
            q = run(par, va)[1]
            loss = -np.mean(w[va] * (y[va] * np.log(q + 1e-12) + (1 - y[va]) * np.log(1 - q + 1e-12)))
            best = min(best, (loss, [a.copy() for a in par]), key=lambda b: b[0])
        want = run(best[1], te)[1]
        assert all(abs(got[t, i] - p) < 1e-8 for i, p in zip(np.flatnonzero(te), want))


def random_pairs(spark, n=400, nodes=40, width=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(nodes, width)).astype(np.float32)
    s, d = rng.integers(0, nodes, n), rng.integers(0, nodes, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * (x[s] * x[d])[:, :2].sum(axis=1)))).astype(int)
    pairs = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(s, d, y)], "src long, dst long, y int")
    return pairs, spark.createDataFrame([(k, x[k].tolist()) for k in range(nodes)], "node_id long, feature array<float>")


def test_trainers_read_products_without_a_shuffle(spark):
    pairs, nodes = random_pairs(spark)
    found = L.pair_features(pairs, nodes)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == pairs.count()


def test_logistic_pairs_equals_sparks(spark):
    pairs, nodes = random_pairs(spark)
    features = L.pair_features(pairs, nodes)
    want = sorted((r.src, r.dst, r.y, r.p) for r in L.fit_predict("lr", features, features).collect())
    got = sorted((r.src, r.dst, r.y, r.p) for r in L.logistic_pairs(pairs, nodes, pairs).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-3)
    one = L.logistic_pairs(pairs.where("y = 1"), nodes, pairs)
    assert {r.p for r in one.collect()} == {1.0}


def test_a_tile_holds_its_sums_once(monkeypatch):
    """Sums of five kinds are the largest table of a task; they were copied before they left it."""
    n, width, kinds = 20_000, 64, 5
    rng, found = np.random.default_rng(1), []

    class Caught:
        def groupBy(self, *_):
            return self

        def cogroup(self, _):
            return self

        def applyInArrow(self, tile, _):
            found.append(tile)

        def select(self, *_):
            return self

    tiles = I.Tiles.__new__(I.Tiles)
    tiles.packed, tiles.kept = Caught(), ["w", "k"]
    monkeypatch.setattr(I.Tiles, "_sent", lambda *_: Caught())
    monkeypatch.setattr(I.Tiles, "added", lambda self, rows, name="feature": rows)
    tiles.sums_by_kind(Caught(), kinds)
    src, dst, w, k = rng.integers(0, n, n), np.arange(n), rng.random(n), rng.integers(0, kinds, n).astype(np.int32)
    cell = lambda x: pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())
    left = pa.table({"n": pa.array([n]), "src": cell(np.diff(src, prepend=0)), "dst": cell(np.diff(dst, prepend=0)), "w": cell(w), "k": cell(k)})
    ids, x = rng.permutation(n), rng.random((n, width))
    right = pa.concat_tables([pa.table({"side": ["src"] * len(c), "node_id": c, "f": I.lists(x[c])}) for c in np.array_split(ids, 7)])
    tracemalloc.start()
    told = found[0](left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = told.column("s").combine_chunks().flatten().to_numpy().reshape(n, kinds, width)
    want = np.zeros((n, kinds, width))
    want[dst, k] = x[src] * w[:, None]
    assert np.allclose(got, want) and peak < 2 * want.nbytes
