"""Cases worked out by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.model import GraphTables
from weftgraph.operators import distances as D
from weftgraph.operators import edges as E
from weftgraph.operators import metrics as M
from weftgraph.operators import neighbors as N
from weftgraph.operators import propagate as P
from weftgraph.operators import scaling as S
from weftgraph.operators import splits as U
from weftgraph.operators import structure as G
from weftgraph.operators import trees as T
from weftgraph.operators.components import connected_components


def pairs(spark, *edges):
    return spark.createDataFrame(list(edges), "u long, v long")


def orbits(spark, *edges):
    return {r.node_id: [r[f"o{k}"] for k in range(15)] for r in G.orbits4(pairs(spark, *edges)).collect()}


def test_orbits(spark):
    assert set(map(tuple, orbits(spark, (0, 1), (1, 2), (2, 3), (0, 3)).values())) == {(2, 2, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0)}
    assert set(map(tuple, orbits(spark, (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)).values())) == {(3, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1)}
    path = orbits(spark, (0, 1), (1, 2), (2, 3))
    assert path[0] == [1, 1, 0, 0, 1] + [0] * 10 and path[1] == [2, 1, 1, 0, 0, 1] + [0] * 9


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.8), (2, 1, 0.7), (3, 0, 0.7)], "id long, y int, p double")
    r = M.rank_metrics(rows).first()
    assert (r.auroc, r.auprc, r.recall_at_k) == pytest.approx((0.625, 0.75, 0.5))
    back = M.rank_metrics(rows.withColumn("p", 1 - F.col("p"))).first()
    assert r.auroc + back.auroc == pytest.approx(1)
    keyed = M.rank_metrics(rows.withColumn("trial", F.lit(1)), ("trial",)).first()
    assert keyed.recall_at_k == pytest.approx(0.5)


def loop_path(spark):
    nodes = spark.createDataFrame([(0, [0.0]), (1, [3.0]), (2, [6.0])], "node_id long, feature array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (0, 0), (1, 1), (2, 2)], "src long, dst long")
    return GraphTables(nodes, edges).validate()


def by_node(df):
    return [r.v for r in sorted(df.collect(), key=lambda r: r.node_id)]


def test_propagation(spark):
    g = loop_path(spark)
    _, one, two = P.hops(g.edges, g.nodes, 2)
    assert by_node(P.long_form(one)) == pytest.approx([1.5, 3, 4.5])
    assert by_node(P.long_form(two)) == pytest.approx([2.25, 3, 3.75])
    assert by_node(P.long_form(P.laplacian(P.normalized_edges(g.edges), g.nodes))) == pytest.approx([-1.224745, -0.449490, 1.775255], abs=1e-6)
    same = spark.createDataFrame([(0, [2.0]), (1, [2.0]), (2, [0.0])], "node_id long, feature array<double>")
    e = spark.createDataFrame([(0, 2), (1, 2)], "src long, dst long")
    assert by_node(P.neighbour(e, same, "std")) == pytest.approx([math.sqrt(1e-5)])
    assert V.bernstein_theta(2) == [[3.0, -3.0, 0.75], [0.0, 3.0, -1.5], [0.0, 0.0, 0.75]]


def test_scaling(spark):
    n = spark.createDataFrame([(0, [1.0, 5.0]), (1, [2.0, 5.0]), (2, [3.0, 5.0])], "node_id long, feature array<double>")
    z = {(r.node_id, r.dim): r.v for r in S.zscored(n).collect()}
    assert [z[i, 0] for i in range(3)] == pytest.approx([-1, 0, 1]) and z[0, 1] == 0
    m = {(r.node_id, r.dim): r.v for r in S.minmaxed(n).collect()}
    assert [m[i, 0] for i in range(3)] == pytest.approx([0, 0.5, 1]) and m[1, 1] == 0


def test_trees(spark):
    rows = {r.pos: (r.parent_pos, r.depth) for r in T.topology(spark, 2, 2).collect()}
    assert len(rows) == 7 and rows[6] == (2, 2) and rows[0] == (None, 0)
    seq = spark.createDataFrame([(9, list(range(8)))], "root long, tokens array<long>")
    assert sorted(tuple(r.path) for r in T.paths(seq, 2, 2).collect()) == [(0, 1, 2, 4), (0, 1, 2, 5), (0, 1, 3, 6), (0, 1, 3, 7)]
    got = {(r.lo, r.hi): (r.has_left, r.has_right) for r in T.row_decisions(spark.createDataFrame([(5, 1), (5, 4)], "row_id long, col_id long")).collect()}
    assert got == {(0, 5): (1, 1), (0, 2): (0, 1), (2, 5): (0, 1), (3, 5): (0, 1)}


def test_distances(spark):
    rows = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.0, 0.5, 0.5])], "graph_id long, h array<double>")
    x, y = rows.where("graph_id = 0"), rows.where("graph_id = 1")
    assert D.mmd(x, y).first().mmd == pytest.approx(2 - 2 * math.exp(-0.125))
    assert D.mmd(rows, rows).first().mmd == pytest.approx(0)
    assert x.select(F.col("h").alias("a"), F.lit(1).alias("k")).join(y.select(F.col("h").alias("b"), F.lit(1).alias("k")), "k").select(D.emd("a", "b").alias("d")).first().d == pytest.approx(1.0)


def test_cnf(spark):
    rows = spark.createDataFrame([(0, 0), (0, 4)], "clause_id long, literal_id long")
    assert T.cnf_clauses(rows, 3).first().clause == "1 -2 0"


def test_lobsters(spark):
    star = [(0, i, 10) for i in (1, 2, 3, 4)]
    star = [(0, 0, i) for i in (1, 2, 3, 4)]
    spider, k = [], 1
    for _ in range(3):
        last = 0
        for _ in range(3):
            spider.append((1, last, k))
            last, k = k, k + 1
    df = spark.createDataFrame(star + spider, "graph_id long, u long, v long")
    assert {r.graph_id: r.is_lobster for r in G.lobsters(df).collect()} == {0: 1, 1: 0}


def test_early_stop(spark):
    rows = M.early_stop(spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.2), (3, 0.2)], "epoch long, score double"), 1).orderBy("epoch").collect()
    assert [r.stop for r in rows] == [0, 0, 0, 1] and [r.counter for r in rows] == [0, 0, 1, 2]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_splits(spark):
    g = loop_path(spark)
    nodes = spark.range(500).select(F.col("id").alias("node_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    r = U.few_label_split(nodes, 1).join(nodes, "node_id").groupBy("role").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert {x.role: (x.n, x.p) for x in r} == {"train": (100, 20), "val": (100, 20), "test": (300, 10)}
    ring = spark.createDataFrame([(i, (i + 1) % 60) for i in range(60)] + [(i, (i + 7) % 60) for i in range(60)], "src long, dst long")
    split = U.link_split(ring, G.spanning_forest(ring), 3).cache()
    assert split.count() == 120 and split.select("src", "dst").distinct().count() == 120
    train = split.where("role = 'train'")
    assert connected_components(train).select("component").distinct().count() == 1
    neg = U.random_negatives(E.symmetrize(ring), 60, 100, 3)
    assert neg.join(E.symmetrize(ring), ["src", "dst"]).count() == 0 and neg.where("src = dst").count() == 0 and neg.count() == 100
    assert g.edges.count() == 7


def test_anonymity_repair(spark):
    nodes = spark.createDataFrame([(i, [float(i % 7)]) for i in range(20)] + [(20, [99.0])], "node_id long, feature array<double>")
    centres = spark.createDataFrame([(0, [0.0]), (1, [6.0]), (2, [99.0])], "cid int, feature array<double>")
    done = N.repair_anonymity(N.nearest_centre(nodes, centres), nodes, centres, 3)
    assert N.anonymity(done, 3).where("ok = 0").count() == 0 and done.count() == 21
