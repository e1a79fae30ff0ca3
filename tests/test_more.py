"""Collections, generators, sources and detectors: by hand, by law, or by a floor on a graph that can be learned."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from weftgraph.model import GraphTables
from weftgraph.operators import collections as C
from weftgraph.operators import generators as G
from weftgraph.operators import layers as L
from weftgraph.operators import metrics, predictors
from weftgraph.operators.neighbors import repair_anonymity
from weftgraph.sources import readers, writers


def pairs(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, u long, v long")


def test_cleaned(spark):
    rows = [(0, 5, 5), (0, 7, 3), (0, 3, 7), (0, 3, 9), (0, 20, 21), (1, 4, 2)]
    found = C.cleaned(spark.createDataFrame(rows, "graph_id long, src long, dst long"))
    assert sorted(map(tuple, found.collect())) == [(0, 0, 1), (0, 0, 2), (1, 0, 1)]


def test_before_gap(spark):
    rows = [(0, 0, 1), (0, 1, 2), (0, 4, 5), (0, 5, 6), (0, 2, 6), (1, 0, 1)]
    found = C.before_gap(spark.createDataFrame(rows, "graph_id long, src long, dst long"))
    assert sorted(map(tuple, found.collect())) == [(0, 0, 1), (0, 1, 2), (1, 0, 1)]


def test_canonical_orders(spark):
    df = pairs(spark, [(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 5), (0, 8, 9)])
    order = lambda kind: [r.node_id for r in C.canonical_order(df, kind).orderBy("place").collect()]
    assert order("bfs") == [1, 2, 3, 4, 5, 8, 9] and order("dfs") == [1, 2, 5, 3, 4, 8, 9]


def test_generated_rows(spark):
    model = spark.createDataFrame([(k, 0.6, 0.5) for k in range(1, 8)], "size_class int, p_left double, p_right double")
    rows = spark.range(1, 200).withColumnRenamed("id", "row_id")
    free = G.generate_rows(model, rows, 3).collect()
    assert {r.row_id for r in free} == set(range(1, 200)) and all(0 <= r.col_id < r.row_id for r in free)
    bounds = rows.select("row_id", F.lit(2).alias("lb"), F.lit(5).alias("ub"))
    count = {}
    for r in G.generate_rows(model, rows, 3, bounds).collect():
        assert 0 <= r.col_id < r.row_id
        count.setdefault(r.row_id, set()).add(r.col_id)
    assert all(min(2, i) <= len(count[i]) <= 5 for i in range(1, 200))


def test_back_to_graph(spark):
    nodes, edges = G.as_graph(spark.createDataFrame([(0, 1), (1, 2)], "u long, v long"), 5, 3)
    assert nodes.count() == 5 and {tuple(r) for r in edges.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)} and nodes.first().feature == [0.0] * 3


def test_draws(spark):
    sizes = spark.createDataFrame([(i, 10 if i % 4 else 50) for i in range(40)], "graph_id long, n long")
    drawn = [r.n for r in G.drawn_sizes(sizes, 4000, 5).collect()]
    assert len(drawn) == 4000 and set(drawn) == {10, 50} and abs(drawn.count(50) / 4000 - 0.25) < 0.03
    rows = spark.createDataFrame([(k, i, float(i)) for k in range(3000) for i in range(3)], "k long, item long, w double")
    picked = [r.item for r in G.tempered(rows, 1.0, 3, "k").collect()]
    share = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert np.allclose([picked.count(i) / 3000 for i in range(3)], share, atol=0.04)
    base = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [0.0])], "node_id long, feature array<double>")
    part = lambda i, x: spark.createDataFrame([(i, [x])], "node_id long, feature array<double>")
    assert sorted(map(tuple, G.scattered(base, part(1, 2.0), part(2, 3.0)).collect())) == [(0, [0.0]), (1, [2.0]), (2, [3.0])]


def test_anonymity(spark):
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)], "node_id long, feature array<double>")
    _, assigned, report = G.quantize(nodes, 15, 3, 8)
    assert assigned.count() == 90 and {r.ok for r in report.collect()} == {1}
    with pytest.raises(ValueError):
        repair_anonymity(assigned, nodes, nodes.limit(0).withColumnRenamed("node_id", "cid"), 91)


def test_private_means(spark):
    nodes = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(4000)], "node_id long, feature array<double>")
    assigned = nodes.select("node_id", F.lit(0).alias("cid"))
    a, b = (np.array(G.private_means(assigned, nodes, 5.0).first().feature) for _ in range(2))
    assert np.abs(a - [0.5, -0.25]).max() < 0.05 and (a != b).all()
    centres = spark.createDataFrame([(0,), (1,)], "cid int")
    found = {r.cid: r.feature for r in G.private_means(assigned, nodes, 5.0, centres=centres).collect()}
    assert set(found) == {0, 1} and len(found[1]) == 2  # a group without nodes has a row of noise


def test_sources(spark, tmp_path):
    nodes = spark.createDataFrame([(i, [float(i)], 0, i == 0, False, i == 2) for i in range(3)], "node_id long, feature array<float>, label int, train_mask boolean, val_mask boolean, test_mask boolean")
    nodes.write.parquet(f"{tmp_path}/g/nodes")
    for name, rows in (("a", [(0, 1)]), ("b", [(0, 1), (1, 2)])):
        spark.createDataFrame(rows, "src long, dst long").write.parquet(f"{tmp_path}/g/relations/etype={name}")
    g = readers.load_graph(spark, f"{tmp_path}/g", "relational", loops=True, both_ways=True)
    assert g.typed.count() == 3 and g.edges.count() == 7 and [r.mark for r in g.nodes.orderBy("node_id").collect()] == [True, False, True]
    with pytest.raises(ValueError):
        readers.load_graph(spark, "x", "unknown")
    with open(tmp_path / "lines.txt", "w") as f:
        f.write("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.i: r.v for r in readers._numbered(spark, f"{tmp_path}/lines.txt", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"line {i}" for i in range(1, 5001)}
    writers.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "node_id long, role string"), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("role = 'test'").first().node_id == 2
    spark.range(1).write.parquet(writers.variant_path(f"{tmp_path}/v", "bigram", "d1", "node", "k2"))
    assert tuple(readers.discover(spark, f"file://{tmp_path}/v").first())[1:] == ("bigram", "d1", "node", "k2")


@pytest.fixture(scope="module")
def planted(spark):
    """Two classes that attract each other, each with a faint own mean: neighbours tell more than the node."""
    rng, n = np.random.default_rng(4), 400
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, 6)) + 0.5 * y[:, None]
    edges = {(int(a), int(b)) for a in range(n) for b in rng.choice(np.flatnonzero(y == y[a]), 6) if a != b}
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), int(y[i])) for i in range(n)], "node_id long, feature array<double>, label int, y int")
    r = random.Random(1)
    typed = spark.createDataFrame([(a, b, r.choice("ab")) for a, b in edges], "src long, dst long, etype string")
    return GraphTables(nodes, typed.select("src", "dst"), typed)


@pytest.mark.parametrize("name", ["gcn", "gin", "sage", "pna", "gat", "bernstein", "chebnet", "amnet", "rgcn"])
def test_detectors_learn(spark, planted, name):
    g = planted
    build = {"gcn": L.gcn, "gin": L.gin, "sage": lambda e, n: L.sage(e, n), "pna": L.pna, "gat": L.gat, "bernstein": L.bernstein_bank, "chebnet": L.chebyshev_bank, "amnet": L.two_filters, "rgcn": lambda e, n: L.rgcn(g.typed, n, ["a", "b"])}[name]
    rows = build(g.edges, g.nodes)
    found = predictors.fit_predict("lr", rows.where("node_id % 2 = 0"), rows.where("node_id % 2 = 1"))
    raw = predictors.fit_predict("lr", g.nodes.where("node_id % 2 = 0"), g.nodes.where("node_id % 2 = 1"))
    area = lambda t: metrics.rank_metrics(t.select(F.col("node_id").alias("id"), "y", "p")).first().auroc
    assert area(found) > max(0.9, area(raw))


def test_model_files(spark, planted, tmp_path):
    rows = predictors.as_vectors(predictors.weighted(planted.nodes))
    model = predictors.REGISTRY["lr"](1).fit(rows)
    writers.save_model(model, {"rate": 0.1, "hops": 2}, str(tmp_path))
    assert writers.load_config(spark, str(tmp_path)) == {"rate": 0.1, "hops": 2}
    assert LogisticRegressionModel.load(f"{tmp_path}/model").coefficients == model.coefficients
