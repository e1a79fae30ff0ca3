"""Writers of graphs, bundles, results and clause files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphTables
from ..operators.trees import cnf_clauses


def write_graph(graph: GraphTables, path: str, mode: str = "errorifexists") -> None:
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).parquet(f"{path}/edges")
    if graph.typed is not None:
        graph.typed.write.mode(mode).parquet(f"{path}/typed")


def write_bundle(path: str, sequences: DataFrame, centres: DataFrame, splits: DataFrame, meta: dict, mode: str = "errorifexists") -> None:
    """A generated set of trees: token sequences by role, cluster centres, split ids and a table of parameters."""
    sequences.write.mode(mode).parquet(f"{path}/sequences")
    centres.write.mode(mode).parquet(f"{path}/centers")
    splits.write.mode(mode).partitionBy("role").parquet(f"{path}/ids")
    sequences.sparkSession.createDataFrame([(k, str(v)) for k, v in meta.items()], "name string, value string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def read_bundle(spark, path: str) -> dict:
    return {"sequences": spark.read.parquet(f"{path}/sequences"), "centers": spark.read.parquet(f"{path}/centers"), "ids": spark.read.parquet(f"{path}/ids"), "meta": {r.name: r.value for r in spark.read.parquet(f"{path}/meta").collect()}}


def variant_path(root: str, generator: str, dataset: str, task: str, variant: str) -> str:
    """One layout for all generators, found again by partition discovery."""
    return f"{root}/generator={generator}/dataset={dataset}/task={task}/variant={variant}"


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Result rows as CSV, partitioned by source."""
    results.write.mode(mode).option("header", True).partitionBy("source").csv(path)


def comparison(results: DataFrame, metric: str, sources: list[str]) -> DataFrame:
    """``dataset, model`` and one formatted column for each source."""
    shown = F.format_string("%.4f ± %.4f", f"{metric}_mean", f"{metric}_std")
    return results.groupBy("dataset", "model").pivot("source", sources).agg(F.first(shown))


def write_cnf(literals: DataFrame, n_var: int, path: str, mode: str = "errorifexists") -> None:
    """A DIMACS text: the header, then a line for each clause in order."""
    clauses = cnf_clauses(literals, n_var)
    head = clauses.agg(F.format_string(f"p cnf {n_var} %d", F.count("*")).alias("value"), F.lit(-1).cast("long").alias("k"))
    head.unionByName(clauses.select(F.col("clause").alias("value"), F.col("clause_id").cast("long").alias("k"))).orderBy("k").select("value").write.mode(mode).text(path)


def write_splits(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with a ``role`` as a folder for each role."""
    rows.write.mode(mode).partitionBy("role").parquet(path)


def save_model(model, config: dict, path: str) -> None:
    """A fitted model of ``pyspark.ml`` beside the settings it was fitted with, as JSON."""
    import json

    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(config, sort_keys=True)
    SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_config(spark, path: str) -> dict:
    import json

    return json.loads(spark.read.text(f"{path}/config").first().value)
