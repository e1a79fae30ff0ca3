"""Readers of graph datasets in their usual file layouts. All but the NumPy archive are read by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import l2_normalized
from ..model import GraphTables
from ..operators.edges import reset_loops, symmetrize, without_loops
from ..operators.order import numbered
from ..storage import materialize


def read_graph(spark: SparkSession, path: str) -> GraphTables:
    """A folder with ``nodes`` and ``edges`` in Parquet, and maybe ``typed``."""
    typed = None
    try:
        typed = spark.read.parquet(f"{path}/typed")
    except Exception as missing:  # no such table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    return GraphTables(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), typed).validate()


def read_for_trees(spark: SparkSession, path: str) -> GraphTables:
    """As ``read_graph``, with unit-length features, both edge directions, and labels from 0."""
    g = read_graph(spark, path)
    low = g.nodes.agg(F.min("label")).first()[0] or 0
    return GraphTables(g.nodes.withColumn("feature", l2_normalized("feature")).withColumn("label", F.col("label") - low), symmetrize(g.edges))


def dictionary(ids: DataFrame, column: str) -> DataFrame:
    """``<column>, node_id``: dense ids in the column's order."""
    return numbered(ids.select(column).distinct(), column).select(column, (F.col("r") - 1).alias("node_id"))


def encoded(pairs: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``src, dst`` by the dictionary, of ``a, b``."""
    one = names.select(F.col(column).alias("a"), F.col("node_id").alias("src"))
    two = names.select(F.col(column).alias("b"), F.col("node_id").alias("dst"))
    return pairs.join(one, "a").join(two, "b").select("src", "dst")


def read_transactions(spark: SparkSession, classes: str, features: str, edges: str, train_until: int = 34, val_until: int = 41) -> tuple[GraphTables, DataFrame]:
    """Three CSVs: ``id, class`` ('1' is the anomaly, 'unknown' has no label), ``id, time step,
    features..`` without header, ``id, id``. Also ``node_id, role`` by time step, for known labels."""
    kinds = spark.read.csv(classes, header=True).toDF("tx", "kind")
    raw = spark.read.csv(features, header=False, inferSchema=False)
    cols = raw.columns
    rows = raw.select(F.col(cols[0]).alias("tx"), F.col(cols[1]).cast("double").cast("int").alias("step"), F.array(*[F.col(c).cast("float") for c in cols[1:]]).alias("feature"))
    pairs = spark.read.csv(edges, header=True).toDF("a", "b")
    names = dictionary(rows, "tx")
    nodes = rows.join(kinds, "tx", "left").join(names, "tx").select("node_id", "feature", F.when(F.col("kind") == "1", 1).when(F.col("kind") == "unknown", F.lit(None)).otherwise(0).cast("int").alias("label"), "step")
    role = nodes.where("label is not null").select("node_id", F.when(F.col("step") <= train_until, "train").when(F.col("step") <= val_until, "val").otherwise("test").alias("role"))
    return GraphTables(nodes.select("node_id", "feature", "label", F.coalesce("label", F.lit(0)).alias("y")), encoded(pairs, names, "tx")), role


def read_archive(spark: SparkSession, path: str, self_features: bool = False) -> GraphTables:
    """A NumPy archive with a CSR adjacency (``adj_*``) and features (``attr_matrix`` or ``attr_*``). The
    archive is one file for one process; its tables are distributed from then on. A + A^T is taken."""
    import numpy as np

    with np.load(path, allow_pickle=False) as z:
        n = int(z["adj_shape"][0])
        src = np.repeat(np.arange(n), np.diff(z["adj_indptr"]))
        dst = z["adj_indices"].astype(np.int64)
        if self_features:
            x = np.eye(n, dtype=np.float32)
        elif "attr_matrix" in z:
            x = z["attr_matrix"].astype(np.float32)
        else:
            x = np.zeros(tuple(z["attr_shape"]), np.float32)
            x[np.repeat(np.arange(n), np.diff(z["attr_indptr"])), z["attr_indices"]] = z["attr_data"]
        y = z["labels"].astype(int) if "labels" in z else np.zeros(n, int)
    import pandas as pd

    nodes = spark.createDataFrame(pd.DataFrame({"node_id": np.arange(n), "feature": list(map(list, x.tolist())), "label": y - y.min()}), "node_id long, feature array<float>, label int")
    edges = spark.createDataFrame(pd.DataFrame({"src": src.astype(np.int64), "dst": dst}), "src long, dst long")
    return GraphTables(nodes.withColumn("y", F.col("label")), symmetrize(edges))


def read_index_archive(spark: SparkSession, path: str) -> tuple[GraphTables, DataFrame]:
    """A NumPy archive with ``x, y, edge_index`` and index lists ``train_mask, valid_mask, test_mask``; class 1 is the anomaly."""
    import numpy as np
    import pandas as pd

    with np.load(path, allow_pickle=False) as z:
        x, y, e = z["x"].astype(np.float32), z["y"].astype(int).ravel(), z["edge_index"].astype(np.int64)
        roles = [(int(i), r) for r, k in (("train", "train_mask"), ("val", "valid_mask"), ("test", "test_mask")) for i in z[k]]
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": np.arange(len(x)), "feature": list(map(list, x.tolist())), "label": (y == 1).astype(int)}), "node_id long, feature array<float>, label int")
    return GraphTables(nodes.withColumn("y", F.col("label")), spark.createDataFrame(pd.DataFrame({"src": e[:, 0], "dst": e[:, 1]}), "src long, dst long")), spark.createDataFrame(roles, "node_id long, role string")


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of text files with their numbers from 1, files in the order of their paths. Lines are counted in
    each stretch of a file that is read at once; what lies before it is a sum over one row for each."""
    lines = spark.read.text(path).select(F.col("value").alias(name), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("at"), F.monotonically_increasing_id().alias("k"))
    lines = materialize(lines, "lines")
    sizes = lines.groupBy("at").agg(F.count("*").alias("n"))
    before = sizes.select("at", (F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    placed = lines.withColumn("r", F.row_number().over(W.partitionBy("at").orderBy("k"))).join(F.broadcast(before), "at")
    return placed.select(name, (F.col("base") + F.col("r")).alias("i"))


def read_text_collection(spark: SparkSession, prefix: str, min_nodes: int = 0, max_nodes: int = 1 << 31) -> tuple[DataFrame, DataFrame]:
    """``<prefix>_A.txt``, ``_graph_indicator.txt``, ``_node_labels.txt`` (1-based, comma separated):
    ``nodes(graph_id, node_id, label)`` and ``edges(graph_id, u, v)``, without loops and isolated nodes, graphs of the wanted sizes."""
    of = _numbered(spark, f"{prefix}_graph_indicator.txt", "g").select("i", F.trim("g").cast("long").alias("graph_id"))
    label = _numbered(spark, f"{prefix}_node_labels.txt", "l").select("i", F.trim("l").cast("int").alias("label"))
    a = spark.read.text(f"{prefix}_A.txt").select(F.split("value", r"\s*,\s*").alias("p")).select(F.trim(F.col("p")[0]).cast("long").alias("a"), F.trim(F.col("p")[1]).cast("long").alias("b")).where("a <> b")
    edges = a.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().join(of.withColumnRenamed("i", "u"), "u").select("graph_id", "u", "v")
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("i")).distinct()
    fit = ends.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n").between(min_nodes, max_nodes)).select("graph_id")
    return ends.join(fit, "graph_id").join(label, "i").select("graph_id", F.col("i").alias("node_id"), "label"), edges.join(fit, "graph_id")


def read_tabular(spark: SparkSession, folder: str) -> GraphTables:
    """``edge.csv[.gz]``, ``node-feat.csv[.gz]`` and ``node-label.csv[.gz]`` without headers, row numbers as ids; made undirected."""
    def lines(name):
        return _numbered(spark, f"{folder}/{name}.csv*", "v").select((F.col("i") - 1).alias("node_id"), "v")

    edges = spark.read.csv(f"{folder}/edge.csv*").select(F.col("_c0").cast("long").alias("src"), F.col("_c1").cast("long").alias("dst"))
    feature = lines("node-feat").select("node_id", F.split("v", ",").cast("array<float>").alias("feature"))
    label = lines("node-label").select("node_id", F.trim("v").cast("int").alias("label"))
    return GraphTables(feature.join(label, "node_id", "left").withColumn("y", F.col("label")), symmetrize(edges))


def read_clause_graphs(spark: SparkSession, folder: str, stats: str) -> DataFrame:
    """``name, left_id, right_id``: edge lists ``u v`` (1-based, clauses after the 2 * n_var literals)
    of files whose names contain a name of the ``name, n_var, n_clause`` table."""
    rows = spark.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    pairs = rows.select("file", F.col("p")[0].cast("long").alias("u"), F.col("p")[1].cast("long").alias("v"))
    known = F.broadcast(spark.read.csv(stats, header=True).select("name", F.col("n_var").cast("long").alias("n_var")))
    named = pairs.join(known, F.contains("file", "name"))
    return named.select("name", (F.least("u", "v") - 1).alias("left_id"), (F.greatest("u", "v") - 1 - 2 * F.col("n_var")).alias("right_id"))


def read_relational(spark: SparkSession, path: str, homogeneous: bool = False) -> GraphTables:
    """A folder with ``nodes`` and one Parquet table of edges for each type under ``relations/etype=..``; the
    types side by side, or as one set of edges. ``mark`` says whether a node is in any of the three roles."""
    nodes = spark.read.parquet(f"{path}/nodes")
    if {"train_mask", "val_mask", "test_mask"} <= set(nodes.columns):
        nodes = nodes.withColumn("mark", F.col("train_mask") | F.col("val_mask") | F.col("test_mask"))
    typed = spark.read.option("basePath", f"{path}/relations").parquet(f"{path}/relations/etype=*").select("src", "dst", F.col("etype").cast("string").alias("etype"))
    edges = typed.select("src", "dst").distinct()
    return GraphTables(nodes, edges, None if homogeneous else typed).validate()


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``graph_id, src, dst`` of a collection in Parquet, without loops."""
    return without_loops(spark.read.parquet(path)).select("graph_id", "src", "dst")


#: Reader of each kind of source; all take a session and a path.
READERS = {
    "graph": read_graph, "trees": read_for_trees, "archive": read_archive, "index_archive": lambda spark, path: read_index_archive(spark, path)[0],
    "tabular": read_tabular, "relational": read_relational,
}


def load_graph(spark: SparkSession, path: str, kind: str = "graph", loops: bool = False, both_ways: bool = False) -> GraphTables:
    """Read a graph of any kind of ``READERS``; a loop at each node and both directions of edges on demand."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}, only for {sorted(READERS)}")
    g = READERS[kind](spark, path)
    edges = symmetrize(g.edges) if both_ways else g.edges
    return GraphTables(g.nodes, reset_loops(edges, g.nodes) if loops else edges, g.typed)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and what it says (``generator, dataset, task, variant``) of the variants under ``root``, by listing folders."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = ["generator", "dataset", "task", "variant"]
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root + "/" + "/".join(f"{n}=*" for n in names))
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    rows = []
    for status in found:
        path = status.getPath().toString()
        rows.append((path, *[part.split("=", 1)[1] for part in path.split("/")[-4:]]))
    return spark.createDataFrame(rows, StructType([StructField(n, StringType()) for n in ["path", *names]]))
