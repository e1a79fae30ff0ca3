"""Pre-training by contrast: the gradient against NumPy, a falling loss, and communities found without labels."""

import numpy as np

from weftgraph.operators import contrast as C


def planted(spark, n=240, seed=3):
    """Three communities with faint means of their own, linked within."""
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, 3, n)
    centre = rng.normal(size=(3, 6)) * 0.6
    x = centre[kind] + rng.normal(size=(n, 6))
    edges = {(int(s), i) for i in range(n) for s in rng.choice(np.flatnonzero(kind == kind[i]), 6) if s != i} | {(int(rng.integers(n)), i) for i in range(0, n, 3)}
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "node_id long, feature array<double>")
    return nodes, spark.createDataFrame(sorted((a, b) for a, b in edges if a != b), "src long, dst long"), kind


def test_shuffled_is_a_permutation(spark):
    nodes, _, _ = planted(spark, 50)
    made = C.shuffled(nodes, 5)
    key = lambda df: sorted(tuple(r.feature) for r in df.collect())
    assert key(made) == key(nodes) and made.select("node_id").distinct().count() == 50
    assert made.join(nodes, ["node_id", "feature"]).count() < 10


def test_gradient(spark):
    nodes, edges, kind = planted(spark)
    net = C.Contrast(edges, nodes, clusters=3, hidden=5, hops=1, seed=2)
    rng = np.random.default_rng(4)
    net.parameters = [net.parameters[0], rng.normal(0, 0.2, 5), rng.normal(0, 0.5, (5, 5))]
    rows = net.placed.collect()
    true, dealt, k = np.array([r.true for r in rows]), np.array([r.dealt for r in rows]), np.array([r.k for r in rows])

    def loss(w, b, m):
        h, g = np.maximum(true @ w + b, 0), np.maximum(dealt @ w + b, 0)
        s = np.array([1 / (1 + np.exp(-h[k == c].mean(0))) for c in range(3)])[k]
        p, q = (1 / (1 + np.exp(-((v @ m) * s).sum(1))) for v in (h, g))
        return -(np.log(p).mean() + np.log(1 - q).mean()) / 2

    grads, value = net.gradient()
    assert abs(value - loss(*net.parameters)) < 1e-9
    for at, g in enumerate(grads):
        for i in range(0, g.size, max(1, g.size // 12)):
            step = np.zeros(g.size)
            step[i] = 1e-6
            moved = lambda sign: [p + (sign * step.reshape(p.shape) if j == at else 0) for j, p in enumerate(net.parameters)]
            assert abs((loss(*moved(1)) - loss(*moved(-1))) / 2e-6 - g.ravel()[i]) < 1e-5


def test_communities_without_labels(spark):
    nodes, edges, kind = planted(spark)
    net = C.Contrast(edges, nodes, clusters=3, hidden=8, hops=2, seed=2)

    def pure(placed):
        found = {r.node_id: r.k for r in placed.select("node_id", "k").collect()}
        k = np.array([found[i] for i in range(len(kind))])
        return sum(np.bincount(kind[k == c], minlength=3).max() for c in range(3)) / len(kind)

    raw = pure(net._clustered(nodes))
    net.fit(epochs=10, every=5)
    assert net.history[-1] < 0.6 < np.log(2) and net.history[-1] < net.history[0]  # chance is log 2
    assert pure(net._clustered(net.encoded())) > max(0.95, raw + 0.2)
