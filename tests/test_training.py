"""Networks trained through their propagation: gradients against NumPy, and floors that a head alone misses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import layers as L
from weftgraph.operators import metrics, predictors
from weftgraph.operators import training as R


def small(spark, seed=3, n=12, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = rng.integers(0, 2, n)
    part = ["train"] * 7 + ["val"] * 3 + ["test"] * 2
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n - 1, (30, 2)) if a != b})  # the last node has no edge
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), part[i]) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    kinds = spark.createDataFrame([(a, b, "ab"[i % 2]) for i, (a, b) in enumerate(edges)], "src long, dst long, etype string")
    return nodes, kinds, x, y, np.array(part)


def dense(net, n):
    """Each bank as a matrix, from what it does to unit vectors."""
    spark = net.nodes.sparkSession
    unit = spark.createDataFrame([(i, [float(i == j) for j in range(n)]) for i in range(n)], "node_id long, feature array<double>")
    out = {}
    for name, bank in net.banks.items():
        m = np.zeros((n, n * bank.parts))
        for r in bank.apply(unit).collect():
            m[r.node_id] = r.feature
        out[name] = m.reshape(n, bank.parts, n).transpose(1, 0, 2)
    return out


def loss(net, mats, x, y, part, weights):
    h = (x - x.mean(0)) / x.std(0, ddof=1)
    for at, block in enumerate(net.blocks):
        h = R.forward(np.hstack([m @ h for b in block.banks for m in mats[b]]), weights[at], at == len(net.blocks) - 1)[-1]
    p, w = R._sigmoid(h[:, 0]), np.where(y == 1, net.positive, 1.0)
    cost = -w * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    return [cost[part == k].sum() / w[part == k].sum() for k in ("train", "val")]


BUILDERS = {
    "gcn": lambda e, t, n: R.gcn_network(e, n, 4), "gin": lambda e, t, n: R.gin_network(e, n, 3, 0.5), "sage": lambda e, t, n: R.sage_network(e, n, 4),
    "rgcn": lambda e, t, n: R.rgcn_network(t, n, ["a", "b"], 3), "wavelet": lambda e, t, n: R.wavelet_network(e, n, 3),
}


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_gradient_equals_numpy(spark, name):
    nodes, typed, x, y, part = small(spark)
    net = BUILDERS[name](typed.select("src", "dst"), typed, nodes)
    rng = np.random.default_rng(9)  # away from the kinks of rectified units
    weights = [[(w, rng.normal(0, 0.3, b.shape)) for w, b in layers] for layers in net.weights]
    grads, train, val = net.gradient(weights)
    mats = dense(net, len(x))
    assert np.allclose([train, val], loss(net, mats, x, y, part, weights), atol=1e-9)
    for k, layers in enumerate(weights):
        row = R.flat(layers)
        for i in rng.choice(row.size, min(row.size, 25), replace=False):
            step = np.zeros(row.size)
            step[i] = 1e-6
            lo, hi = (loss(net, mats, x, y, part, [R.shaped(row + s * step, layers) if j == k else w for j, w in enumerate(weights)])[0] for s in (-1, 1))
            assert abs((hi - lo) / 2e-6 - grads[k][i]) < 1e-5, (name, k, i)
    net.close()


def area(found):
    return metrics.rank_metrics(found.select(F.col("node_id").alias("id"), "y", "p")).first().auroc


def test_training_beats_propagate_then_head(spark):
    """A node's class is that of most of its sources, and theirs hangs on the product of two components: sums of the components
    tell nothing, so the network has to learn before it gathers."""
    rng, n = np.random.default_rng(5), 600
    x = rng.normal(size=(n, 4))
    kind = x[:, 0] * x[:, 1] > 0
    sources = [rng.choice(n, 5, replace=False) for _ in range(n)]
    y = np.array([int(kind[s].mean() > 0.5) for s in sources])
    edges = spark.createDataFrame([(int(s), i) for i, ss in enumerate(sources) for s in ss if s != i], "src long, dst long")
    part = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), str(part[i])) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    mean = R.Edges(R.mean_weights(edges))
    net = R.Network(nodes, [R.Block(("own",), (12,)), R.Block(("mean",), (8, 1))], {"own": R.Same(), "mean": mean}, seed=2).fit(40, 0.08, 40)
    assert net.history[-1][0] < 0.7 * net.history[0][0]
    test = nodes.where("part = 'test'")
    trained = area(test.join(net.scores(), "node_id"))
    rows = L.sage(edges, nodes)
    head = area(predictors.fit_predict("mlp", rows.where("part = 'train'"), rows.where("part = 'test'")))
    assert trained > 0.8 and trained > head + 0.2, (trained, head)
    net.close()


def features_by_label(spark, n=900, seed=7):
    """Each label and share of neighbours' labels has means and deviations of its own."""
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    edges = [(int(s), i) for i in range(n) for s in rng.choice(n, 4, replace=False) if s != i]
    share = np.zeros(n)
    for s, i in edges:
        share[i] += label[s] == 1
    share /= np.maximum(np.bincount([i for _, i in edges], minlength=n), 1)
    scale = np.array([0.3, 1.0, 2.0])[label]
    x = np.column_stack([label + rng.normal(size=n) * scale, 2 * share - label + rng.normal(size=n) * 0.5])
    part = np.array(["train", "train", "train", "val"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i]), str(part[i])) for i in range(n)], "node_id long, feature array<double>, label int, part string")
    return nodes, spark.createDataFrame(edges, "src long, dst long"), x, label


def test_normal_loss(spark):
    nodes, edges, x, label = features_by_label(spark)
    net = R.feature_network(edges, nodes, 3, 6, seed=2)
    part = np.array([r.part for r in nodes.orderBy("node_id").collect()])
    grads, train, _ = net.gradient(net.weights)
    rows = {r.node_id: r.x for r in net.first.select("node_id", "x").collect()}
    inputs = np.array([rows[i] for i in range(len(x))])

    def value(weights):
        z = R.forward(inputs, weights[0], True)[-1]
        log = np.clip(z[:, 2:], R.LEAST_LOG, R.MOST_LOG)
        return 0.5 * (log + (x - z[:, :2]) ** 2 * np.exp(-log)).sum(1)[part == "train"].mean()

    assert abs(train - value(net.weights)) < 1e-9
    row = R.flat(net.weights[0])
    for i in range(0, row.size, 7):
        step = np.zeros(row.size)
        step[i] = 1e-6
        hi, lo = (value([R.shaped(row + s * step, net.weights[0])]) for s in (1, -1))
        assert abs((hi - lo) / 2e-6 - grads[0][i]) < 1e-5
    net.fit(40, 0.05, 40)
    made = {r.node_id: r.feature for r in R.drawn_features(net.outputs(), 5).collect()}
    made = np.array([made[i] for i in range(len(x))])
    for k in range(3):
        for c in range(2):
            a, b = made[label == k, c], x[label == k, c]
            assert abs(a.mean() - b.mean()) < 0.35 * b.std() + 0.1 and 0.75 < a.std() / b.std() < 1.33, (k, c)
    assert abs(made[:, 0].std() / x[:, 0].std() - 1) < 0.15
    net.close()
