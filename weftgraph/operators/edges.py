"""Edge algebra: direction, loops, degrees, subgraphs, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("src", "dst").unionByName(reversed_edges(edges)).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def reset_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exactly one loop at each node."""
    return without_loops(edges).select("src", "dst").unionByName(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))


def canonical(edges: DataFrame, *extra: str) -> DataFrame:
    """Undirected edges ``u < v`` without loops or repeats."""
    return without_loops(edges).select(*extra, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, in_deg, out_deg``, zeros included; one aggregation over both ends of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("node_id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    return nodes.select("node_id").join(counts, "node_id", "left").na.fill(0, ["in_deg", "out_deg"])


def degree_histogram(deg: DataFrame, column: str = "in_deg") -> DataFrame:
    """``degree, n`` for each degree from 0 to the greatest."""
    counts = deg.groupBy(F.col(column).alias("degree")).agg(F.count("*").alias("n"))
    every = deg.agg(F.max(column).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("degree"))
    return every.join(counts, "degree", "left").na.fill(0, ["n"])


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among ``keep.node_id``."""
    return edges.join(keep.select(F.col("node_id").alias("src")), "src", "left_semi").join(keep.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Each edge with columns of both end nodes, as ``src_<c>`` and ``dst_<c>``."""
    a = nodes.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    b = nodes.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns])
    return edges.join(a, "src").join(b, "dst")


def homophily(edges: DataFrame, nodes: DataFrame, train: DataFrame) -> DataFrame:
    """``src, dst, lab, in_train``: 1 for equal labels, else -1; whether both ends are in ``train``."""
    marked = nodes.join(train.select("node_id", F.lit(1).alias("t")), "node_id", "left").na.fill(0, ["t"])
    return with_ends(edges, marked, "y", "t").select("src", "dst", F.when(F.col("src_y") == F.col("dst_y"), 1).otherwise(-1).alias("lab"), ((F.col("src_t") == 1) & (F.col("dst_t") == 1)).cast("int").alias("in_train"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, loops, anomalies, nodes without incoming edges."""
    a = nodes.agg(F.count("*").alias("nodes"), F.sum("y").cast("long").alias("anomalies"), F.lit(1).alias("k"))
    b = edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"), F.lit(1).alias("k"))
    c = nodes.join(edges, nodes.node_id == edges.dst, "left_anti").agg(F.count("*").alias("zero_indeg"), F.lit(1).alias("k"))
    return a.join(F.broadcast(b), "k").join(F.broadcast(c), "k").drop("k")
