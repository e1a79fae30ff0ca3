"""Networks inside sampled trees against NumPy walks of each tree, and what they learn that a root's mean misses."""

import numpy as np
import pytest

from test_training import area
from weftgraph.operators import forests, trees
from weftgraph.operators import training as R


def sampled(spark, n=30, seed=3):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, 3)), rng.integers(0, 2, n)
    part = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), str(part[i])) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n - 1, (3 * n, 2)) if a != b})  # the last node has no edge
    found = trees.sample_trees(spark.createDataFrame(pairs, "src long, dst long"), nodes, 2, 3, 5)
    return nodes, x, found


def walked(kind, slots, x, weights):
    """A root's logit from ``slots``, its tree's filled places with their scaled rows."""

    def row(pos, level):
        if level == 0:
            return x[slots[pos]]
        here = row(pos, level - 1)
        below = [row(3 * pos + k, level - 1) for k in (1, 2, 3) if 3 * pos + k in slots]
        if kind == "gin":
            z = here + sum(below)
        elif kind == "sage":
            z = np.concatenate([here, np.mean(below, 0) if below else np.zeros_like(here)])
        else:
            z = np.mean([here, *below], 0)
        return z if kind == "sgc" else R.forward(z[None], weights[level - 1], level == 2)[-1][0]

    z = row(0, 2)
    return (z @ weights[0][0][0] + weights[0][0][1])[0] if kind == "sgc" else z[0]


@pytest.mark.parametrize("kind", ["sgc", "gcn", "sage", "gin"])
def test_scores_equal_a_walk_of_each_tree(spark, kind):
    nodes, x, found = sampled(spark)
    net = forests.tree_network(found, nodes, kind, 2, 3, 4)
    rows = [r for r in found.collect() if r.node_id is not None]
    every = x[[r.node_id for r in rows]]
    scaled = (x - every.mean(0)) / every.std(0, ddof=1)
    got = {r.node_id: r.p for r in net.scores().collect()}
    assert sorted(got) == list(range(30))
    for root in got:
        slots = {r.pos: r.node_id for r in rows if r.root == root}
        assert abs(got[root] - R._sigmoid(walked(kind, slots, scaled, net.net.weights))) < 1e-9, (kind, root)
    net.close()


@pytest.mark.parametrize("kind", ["gcn", "gat"])
def test_learns_what_stands_below(spark, kind):
    """A root's class stands in its children's first component; its own features say nothing of it."""
    rng, n = np.random.default_rng(8), 360
    side = rng.integers(0, 2, n) * 2 - 1
    x = rng.normal(size=(n, 2)) * 0.3 + np.stack([side * rng.choice([-1, 1], n), np.ones(n)], 1)
    y = (rng.random(n) < 0.5).astype(int)
    edges = []
    for i in range(n):
        want = 1 if y[i] else -1
        edges += [(int(s), i) for s in rng.choice(np.flatnonzero(np.sign(x[:, 0]) == want), 3, replace=False) if s != i]
    part = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), str(part[i])) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    found = trees.sample_trees(spark.createDataFrame(edges, "src long, dst long"), nodes, 2, 3, 5)
    net = forests.tree_network(found, nodes, kind, 2, 3, 8).fit(15, 0.05, 15)
    assert area(nodes.where("part = 'test'").join(net.scores(), "node_id")) > 0.85
    net.close()


def test_unknown_kind(spark):
    nodes, _, found = sampled(spark)
    with pytest.raises(ValueError, match="no network"):
        forests.tree_network(found, nodes, "other", 2, 3)
