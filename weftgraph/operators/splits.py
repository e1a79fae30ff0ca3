"""Splits and samples in an order that is random but fixed: MD5 of a seed and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashed
from ..storage import materialize
from .edges import canonical
from .order import first_rows, numbered, numbered_within


def _roles(train: int, val: int, of: int):
    r, n = F.col("r"), F.col("n")
    return F.when(of * r <= train * n, "train").when(of * r <= (train + val) * n, "val").otherwise("test").alias("role")


def random_split(nodes: DataFrame, seed: int, train: int = 4, val: int = 2, of: int = 10) -> DataFrame:
    """``node_id, role`` with shares ``train/of`` and ``val/of``, the rest test."""
    ranked = numbered(nodes.select("node_id"), hashed(seed, "node_id"), "node_id").withColumn("n", F.lit(nodes.count()))
    return ranked.select("node_id", _roles(train, val, of))


def stratified_split(nodes: DataFrame, seed: int, train: int = 4, val: int = 2, of: int = 10, label: str = "y") -> DataFrame:
    """As ``random_split`` inside each label: quotas are the rounded-down shares of the label's size."""
    ranked = numbered_within(nodes.select("node_id", label), label, hashed(seed, "node_id"), "node_id")
    return ranked.select("node_id", _roles(train, val, of))


def few_label_split(nodes: DataFrame, seed: int, positives: int = 20, negatives: int = 80, label: str = "y") -> DataFrame:
    """``positives`` and ``negatives`` for training, as many for validation, the rest test."""
    ranked = numbered_within(nodes.select("node_id", label), label, hashed(seed, "node_id"), "node_id")
    quota = F.when(F.col(label) == 1, positives).otherwise(negatives)
    return ranked.select("node_id", F.when(F.col("r") <= quota, "train").when(F.col("r") <= 2 * quota, "val").otherwise("test").alias("role"))


def quota_split(nodes: DataFrame, seed: int, quotas: DataFrame) -> DataFrame:
    """Roles of the sizes in ``quotas(lo, hi, role)``: ranks above lo and up to hi."""
    ranked = numbered(nodes.select("node_id"), hashed(seed, "node_id"), "node_id")
    return ranked.join(F.broadcast(quotas), (F.col("r") > F.col("lo")) & (F.col("r") <= F.col("hi"))).select("node_id", "role")


def replicated_split(roles: DataFrame, copies: int = 10) -> DataFrame:
    """``trial, node_id, role``: one given split as that of each trial."""
    return roles.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("trial"), "node_id", "role")


def trials(split, nodes: DataFrame, seeds: list[int]) -> DataFrame:
    """``trial, node_id, role`` for each seed."""
    out = None
    for k, s in enumerate(seeds):
        rows = split(nodes, s).select(F.lit(k).alias("trial"), "node_id", "role")
        out = rows if out is None else out.unionByName(rows)
    return out


def balanced(nodes: DataFrame, seed: int, label: str = "y") -> DataFrame:
    """As many nodes of each label as the rarest has."""
    counted = numbered_within(nodes.select("node_id", label), label, hashed(seed, "node_id"), "node_id")
    least = nodes.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return counted.where(F.col("r") <= least).select("node_id", label)


def redrawn(nodes: DataFrame, seed: int, each: int, label: str = "y") -> DataFrame:
    """``draw, node_id, <label>``: ``each`` draws with replacement from every label; a draw takes the node
    whose place in the label's order is its hash modulo the label's size."""
    ranked = numbered_within(nodes.select("node_id", label), label, "node_id")
    draws = nodes.groupBy(label).agg(F.count("*").alias("__size")).select(label, "__size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long"))).alias("draw"))
    place = F.conv(F.substring(hashed(seed, label, "draw"), 1, 8), 16, 10).cast("long") % F.col("__size") + 1
    return draws.withColumn("r", place).join(ranked, [label, "r"]).select("draw", "node_id", label)


def permuted(nodes: DataFrame, seed: int) -> DataFrame:
    """``node_id, feature`` with the features dealt anew."""
    a = numbered(nodes.select("node_id"), "node_id")
    b = numbered(nodes.select("node_id", "feature"), hashed(seed, "node_id"), "node_id").select("r", "feature")
    return a.join(b, "r").select("node_id", "feature")


def link_split(edges: DataFrame, forest: DataFrame, seed: int, test: tuple[int, int] = (1, 10), val: tuple[int, int] = (1, 20)) -> DataFrame:
    """``src, dst, role`` of undirected edges without loops: the spanning ``forest(u, v)`` trains, so
    training stays connected; of the others the first ``test`` share of all edges tests, the next
    ``val`` share validates."""
    pairs = canonical(edges)
    marked = pairs.join(forest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(1).alias("tree")).distinct(), ["u", "v"], "left")
    total = pairs.count()
    free = numbered(marked.where("tree is null").select("u", "v"), hashed(seed, "u", "v"), "u", "v")
    a = total * test[0] // test[1]
    b = a + total * val[0] // val[1]
    roles = free.select("u", "v", F.when(F.col("r") <= a, "test").when(F.col("r") <= b, "val").otherwise("train").alias("role"))
    return roles.unionByName(marked.where("tree = 1").select("u", "v", F.lit("train").alias("role"))).select(F.col("u").alias("src"), F.col("v").alias("dst"), "role")


def random_negatives(edges: DataFrame, n_nodes: int, count: int, seed: int, spare: int = 2) -> DataFrame:
    """``count`` pairs that are neither edges nor loops: hashed candidates, an exact anti join, the first by
    hash. Where too few candidates are free, twice as many are drawn; once they are as many as there
    are pairs, all free pairs are ranked instead, and if those are too few it is an error."""
    spark, taken = edges.sparkSession, edges.select("src", "dst").distinct()
    digits = 8 if n_nodes <= 1 << 31 else 15  # of an end's half of the hash; fewer would leave ids out
    part = lambda h, a: F.conv(F.substring(h, a, digits), 16, 10).cast("long") % n_nodes
    drawn = count * spare + 100
    while drawn < n_nodes * n_nodes:
        h = hashed(seed, "id")
        pool = spark.range(drawn).select(part(h, 1).alias("src"), part(h, 1 + digits).alias("dst"), h.alias("h")).where("src <> dst")
        pool = pool.groupBy("src", "dst").agg(F.min("h").alias("h")).join(taken, ["src", "dst"], "left_anti")
        found = materialize(first_rows(pool, count, "h", "src", "dst").select("src", "dst"), "negatives")
        if found.count() == count:
            return found
        drawn *= 2
    every = spark.range(n_nodes * n_nodes).select(F.expr(f"id div {n_nodes}").alias("src"), (F.col("id") % n_nodes).alias("dst")).where("src <> dst")
    free = every.join(taken, ["src", "dst"], "left_anti")
    found = materialize(first_rows(free, count, hashed(seed, "src", "dst"), "src", "dst"), "negatives")
    if found.count() < count:
        raise ValueError(f"only {found.count()} pairs are free, not {count}")
    return found


def hard_negatives(edges: DataFrame, seed: int) -> DataFrame:
    """For each edge's source a node two steps away (steps chosen by hash) that is no neighbour and not itself."""
    step = edges.groupBy("src").agg(F.min_by("dst", F.struct(hashed(seed, "src", "dst"), F.col("dst"))).alias("mid"))
    second = edges.groupBy("src").agg(F.min_by("dst", F.struct(hashed(seed + 1, "src", "dst"), F.col("dst"))).alias("dst")).withColumnRenamed("src", "mid")
    return step.join(second, "mid").where("src <> dst").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst")
