"""Readers and writers by round trips over small files."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from weftgraph.model import GraphTables
from weftgraph.sources import readers as R
from weftgraph.sources import writers as O
from weftgraph.streaming.events import activity


def test_graph_round_trip(spark, tmp_path):
    g = GraphTables(spark.createDataFrame([(0, [3.0, 4.0], 2), (1, [0.0, 0.0], 1)], "node_id long, feature array<float>, label int"), spark.createDataFrame([(0, 1)], "src long, dst long"))
    O.write_graph(g, f"{tmp_path}/g")
    back = R.read_for_trees(spark, f"{tmp_path}/g")
    assert back.edges.count() == 2
    assert {r.node_id: (r.feature, r.label) for r in back.nodes.collect()} == {0: ([0.6, 0.8], 1), 1: ([0.0, 0.0], 0)}


def test_transactions(spark, tmp_path):
    (tmp_path / "c.csv").write_text("txId,class\na,1\nb,2\nc,unknown\n")
    (tmp_path / "f.csv").write_text("a,1,0.5\nb,36,1.5\nc,49,2.5\n")
    (tmp_path / "e.csv").write_text("txId1,txId2\na,b\nb,c\n")
    g, role = R.read_transactions(spark, *(f"{tmp_path}/{n}.csv" for n in "cfe"))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (1, 2)]
    assert {r.node_id: r.label for r in g.nodes.collect()} == {0: 1, 1: 0, 2: None}
    assert {r.node_id: r.role for r in role.collect()} == {0: "train", 1: "val"}


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", adj_shape=[3, 3], adj_indptr=[0, 1, 2, 2], adj_indices=[1, 2], attr_matrix=np.eye(3), labels=[1, 2, 2])
    g = R.read_archive(spark, str(tmp_path / "a.npz"))
    assert g.edges.count() == 4 and sorted(r.label for r in g.nodes.collect()) == [0, 1, 1]
    np.savez(tmp_path / "b.npz", x=np.eye(2), y=[1, 2], edge_index=[[0, 1]], train_mask=[0], valid_mask=[1], test_mask=[])
    g, role = R.read_index_archive(spark, str(tmp_path / "b.npz"))
    assert g.edges.count() == 1 and role.count() == 2


def test_text_collection(spark, tmp_path):
    (tmp_path / "X_A.txt").write_text("1, 2\n2, 1\n3, 3\n4, 5\n")
    (tmp_path / "X_graph_indicator.txt").write_text("1\n1\n1\n2\n2\n")
    (tmp_path / "X_node_labels.txt").write_text("7\n8\n9\n7\n8\n")
    nodes, edges = R.read_text_collection(spark, f"{tmp_path}/X")
    assert sorted(map(tuple, edges.collect())) == [(1, 1, 2), (2, 4, 5)]
    assert nodes.count() == 4


def test_tabular(spark, tmp_path):
    (tmp_path / "edge.csv").write_text("0,1\n1,2\n")
    (tmp_path / "node-feat.csv").write_text("1.0,2.0\n3.0,4.0\n5.0,6.0\n")
    with gzip.open(tmp_path / "node-label.csv.gz", "wt") as f:
        f.write("0\n1\n2\n")
    g = R.read_tabular(spark, str(tmp_path))
    assert g.edges.count() == 4 and {r.node_id: r.label for r in g.nodes.collect()} == {0: 0, 1: 1, 2: 2}


def test_clauses(spark, tmp_path):
    d = tmp_path / "edges"
    d.mkdir()
    (d / "foo_lcg.txt").write_text("1 5\n4 5\n")
    (tmp_path / "stats.csv").write_text("name,n_var,n_clause\nfoo,2,1\n")
    rows = R.read_clause_graphs(spark, str(d), f"{tmp_path}/stats.csv")
    assert sorted((r.left_id, r.right_id) for r in rows.collect()) == [(0, 0), (3, 0)]
    O.write_cnf(rows.select(F.col("right_id").alias("clause_id"), F.col("left_id").alias("literal_id")), 2, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["p cnf 2 1", "1 -2 0"]


def test_bundle_and_results(spark, tmp_path):
    seq = spark.createDataFrame([(0, [1, 2])], "root long, tokens array<long>")
    ids = spark.createDataFrame([(0, "train")], "node_id long, role string")
    O.write_bundle(f"{tmp_path}/b", seq, spark.createDataFrame([(0, [0.0])], "cid int, feature array<double>"), ids, {"depth": 2})
    back = O.read_bundle(spark, f"{tmp_path}/b")
    assert back["meta"] == {"depth": "2"} and back["sequences"].count() == 1
    res = spark.createDataFrame([("real", "d", "rf", 0.5, 0.1), ("made", "d", "rf", 0.25, 0.0)], "source string, dataset string, model string, auroc_mean double, auroc_std double")
    O.write_results(res, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 2
    assert O.comparison(res, "auroc", ["real", "made"]).first().real == "0.5000 ± 0.1000"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = activity(stream, late="2 days").writeStream.outputMode("complete").format("memory").queryName("activity").start()
    try:
        q.processAllAvailable()
        got = sorted((r.day, r.event_type, r.n) for r in spark.table("activity").collect())
    finally:
        q.stop()
    assert got == sorted((r.day, r.event_type, r.n) for r in activity(rows).collect())
