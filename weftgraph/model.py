"""Graphs as tables: nodes with features and labels, edges, edge types, graph collections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("feature", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
#: The seeds of ten trials.
SEEDS = [3407 + 10 * k for k in range(10)]


@dataclass(frozen=True)
class GraphTables:
    """``nodes(node_id, feature, label, y)`` and ``edges(src, dst)``, and optional typed edges."""

    nodes: DataFrame
    edges: DataFrame
    typed: DataFrame | None = None

    def validate(self) -> "GraphTables":
        """Raise unless both tables have the columns and kinds that the operators read."""
        have = {f.name: f.dataType.simpleString() for f in self.nodes.schema}
        if have.get("node_id") != "bigint" or not have.get("feature", "").startswith("array<"):
            raise ValueError(f"nodes need node_id bigint and feature array, not {have}")
        have = {f.name: f.dataType.simpleString() for f in self.edges.schema}
        if have.get("src") != "bigint" or have.get("dst") != "bigint":
            raise ValueError(f"edges need src and dst bigint, not {have}")
        return self


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def test_graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    """The graph that the test tables hold: embeddings are nodes, orders are edges between them."""
    n = node_count(spark, sf_dir)
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("feature"), "label", (F.col("label") == 0).cast("int").alias("y"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % n).alias("src"), (F.col("o_custkey") % n).alias("dst"), F.col("o_orderpriority").alias("etype"))
    return GraphTables(nodes, orders.select("src", "dst").distinct(), orders.distinct())


def test_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``graph_id, src, dst`` of one graph for each nation of the ordering customer."""
    n = node_count(spark, sf_dir)
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(F.col("c_nationkey").cast("long").alias("graph_id"), (F.col("o_orderkey") % n).alias("src"), (F.col("o_custkey") % n).alias("dst")).distinct()
