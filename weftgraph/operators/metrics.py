"""Ranking and classification metrics, reports over trials, early stopping.

Scores are collapsed to distinct values before they are ordered. Over all rows the running sums come
from a sort over all tasks (``order``); inside groups from a window of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .order import running_sums


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, "p").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))


def rank_metrics(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``auroc, auprc, recall_at_k`` of rows ``<keys>, id, y, p``. AUROC counts ties as a half; AUPRC is
    average precision over distinct thresholds; K is the number of positives, ties by id."""
    keys = list(keys)
    levels = _by_score(scored, keys)
    if keys:
        down = W.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
        run = levels.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
        every = W.partitionBy(*keys)
        run = run.withColumn("np", F.sum("pos").over(every)).withColumn("nn", F.sum(F.col("n") - F.col("pos")).over(every))
    else:
        all_ = scored.agg(F.sum("y").cast("double").alias("np"), F.count("*").cast("double").alias("n")).first()
        run = running_sums(levels, [F.desc("p")], tp=F.col("pos"), seen=F.col("n")).withColumn("np", F.lit(all_.np)).withColumn("nn", F.lit(all_.n - (all_.np or 0.0)))
    below = F.col("nn") - (F.col("seen") - F.col("tp"))
    curve = run.groupBy(*keys).agg(
        (F.sum(F.col("pos") * (below + 0.5 * (F.col("n") - F.col("pos")))) / (F.first("np") * F.first("nn"))).alias("auroc"), (F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.first("np")).alias("auprc"),
    )
    # Whole score levels above K count as they are; inside the level that K cuts, ids decide.
    cut = run.where((F.col("seen") - F.col("n") < F.col("np")) & (F.col("seen") >= F.col("np"))).select(*keys, F.col("p").alias("at"), (F.col("np") - (F.col("seen") - F.col("n"))).alias("room"), (F.col("tp") - F.col("pos")).alias("above"), "np")
    if keys:
        edge = scored.join(cut, keys).where(F.col("p") == F.col("at"))
    else:
        edge = scored.join(F.broadcast(cut), scored.p == cut["at"])
    inside = edge.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).groupBy(*keys).agg(((F.first("above") + F.sum(F.when(F.col("r") <= F.col("room"), F.col("y")).otherwise(0))) / F.first("np")).alias("recall_at_k"))
    if keys:
        return curve.join(inside, keys)
    return curve.withColumn("__k", F.lit(1)).join(F.broadcast(inside.withColumn("__k", F.lit(1))), "__k").drop("__k")


def f1_scores(predicted: DataFrame) -> DataFrame:
    """``f1_micro, f1_macro`` of rows ``y, yhat``; macro over the labels in either column."""
    cells = predicted.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("yhat").alias("c"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("t")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("t").alias("t"))
    return per.agg((F.sum("t") / F.sum("a")).alias("f1_micro"), F.avg(2 * F.col("t") / (F.col("a") + F.col("b"))).alias("f1_macro"))


def trial_report(trials: DataFrame, metrics: tuple[str, ...] = ("auroc", "auprc", "recall_at_k")) -> DataFrame:
    """Mean and population standard deviation of each metric over trials, per source, dataset and model."""
    keys = [c for c in ("source", "dataset", "model") if c in trials.columns]
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), *[f(m).alias(f"{m}_{s}") for m in metrics for s, f in (("mean", F.avg), ("std", F.stddev_pop))])


def trial_pivot(trials: DataFrame, metric: str, rows: str, columns: str, values: list[str]) -> DataFrame:
    return trials.groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def early_stop(scores: DataFrame, patience: int) -> DataFrame:
    """``epoch, score, best, counter, stop`` of ``epoch, score``: the counter of epochs since the last
    strict improvement; the first epoch at which it passes ``patience`` stops. One run's epochs, so one task."""
    past = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    upto = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    rows = scores.withColumn("before", F.max("score").over(past)).withColumn("best", F.max("score").over(upto))
    rows = rows.withColumn("up", F.when(F.col("before").isNull() | (F.col("score") > F.col("before")), F.col("epoch"))).withColumn("last", F.max("up").over(upto))
    rows = rows.withColumn("counter", F.col("epoch") - F.col("last")).withColumn("stop", (F.col("counter") > patience).cast("int"))
    return rows.select("epoch", "score", "best", "counter", "stop")


def window_stop(losses: DataFrame, size: int) -> DataFrame:
    """``epoch, loss, stop``: 1 where the loss has risen in each of the last ``size`` epochs."""
    order = W.orderBy("epoch")
    up = losses.withColumn("up", (F.col("loss") > F.lag("loss").over(order)).cast("int"))
    run = order.rowsBetween(-(size - 1), 0)
    return up.select("epoch", "loss", ((F.min(F.coalesce("up", F.lit(0))).over(run) == 1) & (F.count("*").over(run) == size)).cast("int").alias("stop"))


def best_config(results: DataFrame) -> DataFrame:
    """The configuration of the best validation score of each model and dataset."""
    return results.groupBy("dataset", "model").agg(F.max_by("config", F.struct("score", "config")).alias("config"), F.max("score").alias("score"))
