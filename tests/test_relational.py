"""Detectors that learn along, and outlier detectors."""

import numpy as np

from test_training import area
from weftgraph.operators import outliers as O
from weftgraph.operators import relational as B
from weftgraph.operators.neighbors import knn


def planted(spark, n=300, seed=4):
    """Two classes told apart by faint means; relation "clean" links mostly within a class, "noise" anyone."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.35).astype(int)
    x = rng.normal(size=(n, 5)) + 0.8 * y[:, None]
    rows = []
    for i in range(n):
        rows += [(int(s), i, "clean") for s in rng.choice(np.flatnonzero(y == y[i]), 6)]
        rows += [(int(s), i, "noise") for s in rng.choice(np.flatnonzero(y != y[i]), 4)] + [(int(s), i, "noise") for s in rng.choice(n, 2)]
    part = np.array(["train", "train", "val", "test"])[np.arange(n) % 4]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), str(part[i])) for i in range(n)], "node_id long, feature array<double>, y int, part string")
    return nodes, spark.createDataFrame(sorted(set(rows)), "src long, dst long, etype string")


def test_shares_follow_the_learned_distance(spark):
    nodes, typed = planted(spark)
    net, chooser = B.chosen_neighbours(typed, nodes, ["clean", "noise"], rounds=5, epochs=3)
    assert chooser.shares["clean"] > chooser.shares["noise"] and set(chooser.moves) == {"clean", "noise"}
    assert len(set(map(tuple, chooser.moves.values()))) == 2  # they did not move in step
    assert area(nodes.where("part = 'test'").join(net.scores(), "node_id")) > 0.85
    net.close()


def test_settled_shares_rest():
    c = B.Chooser({"a": 0.5})
    for k in range(30):
        c.learn({"a": 1.0 + (k % 2)}, 0.1)
    assert len(c.moves["a"]) == 10 and abs(c.shares["a"] - 0.5) < 0.11


def test_trees_follow_the_gradient(spark):
    nodes, typed = planted(spark, 240, 6)
    edges = typed.where("etype = 'clean'").select("src", "dst")
    net, losses = B.boosted_network(edges, nodes, rounds=3, epochs=4)
    assert len(losses) == 3 and losses[0] > losses[1] > losses[2]
    assert area(nodes.where("part = 'test'").join(net.scores(), "node_id")) > 0.85
    back = {r.node_id: r.back for r in net.input_gradient().collect()}
    assert len(back) == 240 and len(back[0]) == 6
    net.close()


def test_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (180, 4)), rng.normal(6, 0.3, (60, 4)), rng.uniform(-12, 12, (15, 4))])
    y = [0] * 240 + [1] * 15
    nodes = spark.createDataFrame([(i, [float(v) for v in r], y[i]) for i, r in enumerate(x)], "node_id long, feature array<double>, y int")
    found = O.isolation_scores(nodes, trees=60, sample=64)
    assert area(nodes.join(found, "node_id")) > 0.95 and nodes.join(found, "node_id").where("p <= 0 or p >= 1").count() == 0
    k = 8
    lof = {r.node_id: r.p for r in O.local_outlier_factor(knn(nodes, nodes, k, "l2", 12)).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(d, near, 1)[:, -1]
    dense = 1 / np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(1)
    want = dense[near].mean(1) / dense
    assert np.allclose([lof[i] for i in range(len(x))], want, rtol=1e-4)
    assert area(nodes.join(spark.createDataFrame([(i, float(p)) for i, p in lof.items()], "node_id long, p double"), "node_id")) > 0.95
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "node_id long, feature array<double>")
    assert {round(r.p, 6) for r in O.local_outlier_factor(knn(same, same, 3, "l2")).collect()} == {1.0}
    assert O.isolation_scores(nodes.limit(0)).count() == 0
