"""k-means in which each cluster has a least number of members."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..storage import discard, materialize
from . import propagate as P
from .order import numbered_within

#: Centres that may be sent to all tasks.
MOST_CENTRES = 100_000


def _table(centres: DataFrame):
    """One row with all centres as an array, checked to be few."""
    rows = centres.select("cid", F.col("feature").cast("array<double>").alias("feature"))
    if rows.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    return F.broadcast(rows.agg(F.collect_list(F.struct("cid", "feature")).alias("__centres")))


def _best(column, less=0.0):
    """Of the centres of a row the nearest, as (squared distance less something, cid); the lowest id on ties."""
    return F.array_min(F.transform("__centres", lambda c: F.struct(F.round(V.squared_l2_distance(column, c["feature"]) - less, 9).alias("d"), c["cid"].alias("cid"))))


def assign_at_least(nodes: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``node_id, cid, d`` (squared distance): every centre gets ``k`` nodes or more, at little more cost than the nearest
    centres. Fewer than ``k`` nodes for each centre are an error.

    Nodes start at their nearest centre. In each round every node of a centre with nodes to spare offers itself to the
    needy centre where it would cost least more; a centre takes the cheapest offers it needs, and a centre gives no more than it
    can spare. Offers are numbered by a sort over all tasks, so one needy centre that all nodes offer
    themselves to is no bottleneck. The cheapest offer of all is always taken, so there is an end."""
    if nodes.count() < k * centres.count():
        raise ValueError(f"fewer than {k} nodes for each centre")
    rows = nodes.select("node_id", F.col("feature").cast("array<double>").alias("feature"))
    now = materialize(rows.crossJoin(_table(centres)).select("node_id", "feature", _best("feature").alias("m")).select("node_id", "feature", "m.cid", "m.d"), "assigned")
    while True:
        sizes = centres.select("cid").join(now.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left").na.fill(0, ["n"])
        sizes = materialize(sizes.withColumn("over", F.col("n") - k), "sizes")  # a row for each centre
        needy = sizes.where("over < 0").select("cid", (-F.col("over")).alias("short"))
        if needy.isEmpty():
            return now.select("node_id", "cid", "d")
        movable = now.join(sizes.where("over > 0").select("cid", "over"), "cid")
        offers = movable.crossJoin(_table(centres.join(needy, "cid"))).select("node_id", "cid", "over", _best("feature", F.col("d")).alias("m")).select("node_id", "cid", "over", F.col("m.cid").alias("to"), F.col("m.d").alias("more"))
        ranked = numbered_within(offers, "to", "more", "node_id", name="place", size="offered").join(needy.withColumnRenamed("cid", "to"), "to").where("place <= short")
        taken = ranked.withColumn("__g", F.row_number().over(W.partitionBy("cid").orderBy("more", "node_id"))).where("__g <= over")
        moves = materialize(taken.select("node_id", "to", "more"), "moves")
        moved = now.join(moves, "node_id", "left").select("node_id", "feature", F.coalesce("to", "cid").alias("cid"), F.when(F.col("to").isNull(), F.col("d")).otherwise(F.col("d") + F.col("more")).alias("d"))
        before, now = now, materialize(moved, "assigned")
        discard(before, moves, sizes)


def means(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cid, feature``: the mean of each group."""
    rows = nodes.join(assigned.select("node_id", "cid"), "node_id").select("cid", P.as_vector("feature").alias("v"))
    return rows.groupBy("cid").agg(Summarizer.mean(F.col("v")).alias("m")).select("cid", vector_to_array("m").alias("feature"))


def constrained_kmeans(nodes: DataFrame, clusters: int, k: int, rounds: int = 4, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Centres ``cid, feature`` and ``node_id, cid, d``: exactly ``clusters`` groups of ``k`` nodes or more. Begins with k-means
    (centres that it leaves out are drawn among the nodes) and goes on, assignment and means in turn, while the cost falls."""
    from pyspark.ml.clustering import KMeans

    spark = nodes.sparkSession
    model = KMeans(k=clusters, featuresCol="v", seed=seed).fit(nodes.select(P.as_vector("feature").alias("v")))
    rows = [[float(x) for x in c] for c in model.clusterCenters()]
    if len(rows) < clusters:  # fewer different points than clusters
        rows += [[float(x) for x in r.feature] for r in nodes.orderBy(F.xxhash64("node_id"), "node_id").select("feature").limit(clusters - len(rows)).collect()]
    centres = materialize(spark.createDataFrame(list(enumerate(rows)), "cid int, feature array<double>"), "centres")
    best = None
    for _ in range(rounds):
        assigned = assign_at_least(nodes, centres, k)
        cost = assigned.agg(F.sum("d")).first()[0]
        if best is not None and cost >= best[0] * (1 - 1e-6):
            break
        best = (cost, centres, assigned)
        centres = materialize(means(assigned, nodes), "centres")
    return best[1], best[2]
