"""Signed edges learned with the head: gradient against NumPy, signs and scores on a planted graph."""

import numpy as np

from test_training import area, small
from weftgraph.operators import signed as S
from weftgraph.operators import training as R


def loss(net, rows, x, y, part, weights):
    (w, b), judge = weights[0][0], weights[1][0]
    z = (x - x.mean(0)) / x.std(0, ddof=1) @ w + b
    came, costs = np.zeros_like(z), {1: [], -1: []}
    degree = {j: sum(d == j for _, d in rows) for _, j in rows}
    for i, j in rows:
        s = S.signs_of(z[i : i + 1], z[j : j + 1], judge)[0]
        came[j] += s * z[i] / degree[j]
        if part[i] == part[j] == "train":
            t = 1 if y[i] == y[j] else -1
            costs[t].append(max(0, 1 - t * s))
    r = np.hstack([z, came])
    p = R._sigmoid(R.forward(r, weights[2], True)[-1][:, 0])
    wt = np.where(y == 1, net.positive, 1.0)
    cost = -wt * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    out = [cost[part == s].sum() / wt[part == s].sum() for s in ("train", "val")]
    out[0] += net.hinge * sum(np.mean(c) for c in costs.values() if c)
    for k in (0, 1):
        here = r[(part == "train") & (y == k)]
        out[0] += net.pull * ((here - here.mean(0)) ** 2).mean() if len(here) else 0
    return out


def test_gradient_equals_numpy(spark):
    nodes, typed, x, y, part = small(spark)
    rows = [(r.src, r.dst) for r in typed.collect()]
    net = S.SignedNetwork(nodes, [], {}, edges=typed.select("src", "dst"), hidden=3, head=(4, 1), hinge=0.7, pull=0.4)
    rng = np.random.default_rng(9)
    weights = [[(rng.normal(0, 0.5, w.shape), rng.normal(0, 0.3, b.shape)) for w, b in layers] for layers in net.weights]
    grads, train, val = net.gradient(weights)
    assert np.allclose([train, val], loss(net, rows, x, y, part, weights), atol=1e-9)
    for k, layers in enumerate(weights):
        row = R.flat(layers)
        for i in range(row.size):
            step = np.zeros(row.size)
            step[i] = 1e-6
            lo, hi = (loss(net, rows, x, y, part, [R.shaped(row + s * step, layers) if j == k else w for j, w in enumerate(weights)])[0] for s in (-1, 1))
            assert abs((hi - lo) / 2e-6 - grads[k][i]) < 1e-5, (k, i)
    net.close()


def test_signs_and_scores_of_a_graph_of_strangers(spark):
    """Most edges link nodes of unlike classes, so that plain means mislead; own features are faint."""
    rng, n = np.random.default_rng(2), 300
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 4)) + 1.1 * y[:, None]
    edges = set()
    for i in range(n):
        edges |= {(int(s), i) for s in rng.choice(np.flatnonzero(y != y[i]), 6)} | {(int(s), i) for s in rng.choice(np.flatnonzero(y == y[i]), 2) if s != i}
    part = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), str(part[i])) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    graph = spark.createDataFrame(sorted(edges), "src long, dst long")
    net = S.SignedNetwork(nodes, [], {}, edges=graph).fit(25, 0.05, 25)
    assert net.history[-1][0] < net.history[0][0]
    assert area(nodes.where("part = 'test'").join(net.scores(), "node_id")) > 0.9
    unseen = [(r.sign, y[r.src] == y[r.dst]) for r in net.signs().collect() if part[r.src] != "train" and part[r.dst] != "train"]
    alike, unlike = ([s for s, a in unseen if a == want] for want in (True, False))
    assert np.mean(alike) > np.mean(unlike) + 0.5
    net.close()


def test_odd_graphs(spark):
    """Nodes with null labels, no labelled edges, no edges at all."""
    rows = [(i, [float(i), 1.0], None if i > 5 else i % 2, "train" if i < 4 else "test" if i > 5 else "val") for i in range(9)]
    nodes = spark.createDataFrame(rows, "node_id long, feature array<double>, y int, part string")
    for edges in ([(7, 8), (7, 8), (8, 8)], []):
        net = S.SignedNetwork(nodes, [], {}, edges=spark.createDataFrame(edges, "src long, dst long"), hidden=2).fit(2)
        assert sorted(r.node_id for r in net.scores().collect()) == list(range(9)) and net.signs().count() == len(edges)
        net.close()
