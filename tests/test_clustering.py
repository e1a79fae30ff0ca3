"""Clusters of a least size: sizes, and cost against the optimum of small inputs."""

import numpy as np
import pytest

from weftgraph.operators import clustering as C


def optimum(x, centres, k):
    """Least cost of all assignments with ``k`` members for each centre, by going through the points with the sizes so far."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(-1)
    best = {(0,) * len(centres): 0.0}
    for row in d:
        new = {}
        for sizes, cost in best.items():
            for c, more in enumerate(row):
                key = tuple(min(k, n + (i == c)) for i, n in enumerate(sizes))
                new[key] = min(new.get(key, np.inf), cost + more)
        best = new
    return best[(k,) * len(centres)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_the_optimum(spark, seed):
    rng = np.random.default_rng(seed)
    x, centres = rng.normal(size=(40, 2)), rng.normal(size=(5, 2)) * 1.5
    nodes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, feature array<double>")
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(centres)], "cid int, feature array<double>")
    got = C.assign_at_least(nodes, table, 7).collect()
    sizes = np.bincount([r.cid for r in got], minlength=5)
    assert len(got) == 40 and sizes.min() >= 7
    cost = sum(((x[r.node_id] - centres[r.cid]) ** 2).sum() for r in got)
    assert abs(cost - sum(r.d for r in got)) < 1e-6
    assert cost <= 1.1 * optimum(x, centres, 7)


def test_one_far_centre_and_too_few(spark):
    nodes = spark.createDataFrame([(i, [float(i % 10), 0.0]) for i in range(60)], "node_id long, feature array<double>")
    centres = spark.createDataFrame([(0, [4.0, 0.0]), (1, [1000.0, 0.0]), (2, [-1000.0, 0.0])], "cid int, feature array<double>")
    got = C.assign_at_least(nodes, centres, 20).collect()
    by = {c: sorted(r.node_id % 10 for r in got if r.cid == c) for c in range(3)}
    assert {c: len(v) for c, v in by.items()} == {0: 20, 1: 20, 2: 20}
    assert min(by[1]) >= 6 and max(by[2]) <= 3
    with pytest.raises(ValueError):
        C.assign_at_least(nodes, centres, 21)


def test_exactly_the_asked_clusters(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.1, (50, 3)), rng.normal(4, 0.1, (4, 3)), rng.normal(-4, 0.1, (6, 3))])
    nodes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, feature array<double>")
    centres, assigned = C.constrained_kmeans(nodes, 6, 8)
    sizes = {r.cid: r["count"] for r in assigned.groupBy("cid").count().collect()}
    assert centres.count() == len(sizes) == 6 and min(sizes.values()) >= 8 and sum(sizes.values()) == 60
    same = spark.createDataFrame([(i, [1.0]) for i in range(12)], "node_id long, feature array<double>")
    _, alike = C.constrained_kmeans(same, 4, 3)
    assert sorted(r["count"] for r in alike.groupBy("cid").count().collect()) == [3, 3, 3, 3]
