"""Attention's gradient against NumPy, and that learned weights find the neighbours that matter."""

import numpy as np
import pytest

from weftgraph.operators import attention as A

from weftgraph.operators import training as R

from test_training import area, small


def loss(net, rows, x, y, part, weights):
    """The same network over dense loops, with an ordinary softmax."""
    h, (w, b) = net.heads, weights[0][0]
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    z = x @ w + b
    v = z[:, : h.values].reshape(len(x), h.types, h.heads, h.width)
    k = z[:, h.values : h.values + h.keys].reshape(len(x), h.types, h.heads, h.key)
    q = z[:, h.values + h.keys :].reshape(len(x), h.types, h.heads, h.key)
    out = np.zeros_like(v)
    for t in range(h.types):
        for j in range(len(x)):
            near = [a for a, c, kind in rows if c == j and kind == t]
            for m in range(h.heads if near else 0):
                e = np.array([A.leaky(k[i, t, m, 0] + q[j, t, m, 0]) if h.kind == "additive" else k[i, t, m] @ q[j, t, m] / np.sqrt(h.width) for i in near])
                soft = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
                out[j, t, m] = soft @ v[near, t, m]
    flat = out.reshape(len(x), -1)
    p = R._sigmoid(R.forward(np.hstack([x, flat]) if net.separate else flat, weights[1], True)[-1][:, 0])
    wt = np.where(y == 1, net.positive, 1.0)
    cost = -wt * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    return [cost[part == s].sum() / wt[part == s].sum() for s in ("train", "val")]


@pytest.mark.parametrize("kind", ["additive", "dot", "typed"])
def test_gradient_equals_numpy(spark, kind):
    nodes, typed, x, y, part = small(spark)
    if kind == "typed":
        net = A.typed_attention_network(typed, nodes, ["a", "b"], 2, 2)
    else:
        net = A.gat_network(typed.select("src", "dst"), nodes, 2, 3, kind == "dot", kind)
    rows = [(r.src, r.dst, r.k) for r in net.edges.collect()]
    rng = np.random.default_rng(9)
    weights = [[(w, rng.normal(0, 0.3, b.shape)) for w, b in layers] for layers in net.weights]
    grads, train, val = net.gradient(weights)
    assert np.allclose([train, val], loss(net, rows, x, y, part, weights), atol=1e-9)
    for k, layers in enumerate(weights):
        row = R.flat(layers)
        for i in range(0, row.size, max(1, row.size // 60)):
            step = np.zeros(row.size)
            step[i] = 1e-6
            lo, hi = (loss(net, rows, x, y, part, [R.shaped(row + s * step, layers) if j == k else w for j, w in enumerate(weights)])[0] for s in (-1, 1))
            assert abs((hi - lo) / 2e-6 - grads[k][i]) < 1e-5, (kind, k, i)
    net.close()


def test_attention_learns_whom_to_heed(spark):
    """A node's class is a component of the one neighbour whose flag is set; the mean over all is mostly noise."""
    rng, n = np.random.default_rng(6), 400
    flag = rng.random(n) < 0.2
    x = np.column_stack([flag * 2.0, rng.normal(size=n) * np.where(flag, 1, 4), rng.normal(size=n)])
    heeded, others = np.flatnonzero(flag), np.flatnonzero(~flag)
    edges, y = [], []
    for i in range(n):
        own = int(rng.choice(heeded))
        y.append(int(x[own, 1] > 0))
        edges += [(own, i)] + [(int(o), i) for o in rng.choice(others, 5, replace=False)]
    part = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], y[i], str(part[i])) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    table = spark.createDataFrame(sorted(set(edges)), "src long, dst long")
    net = A.gat_network(table, nodes, 2, 4, True, seed=3).fit(25, 0.1, 25)
    test = nodes.where("part = 'test'")
    assert net.history[-1][0] < 0.6 * net.history[0][0] and area(test.join(net.scores(), "node_id")) > 0.85
    net.close()
