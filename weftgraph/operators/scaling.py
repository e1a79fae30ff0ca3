"""Scaling of feature columns, and how far generated features lie from real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .propagate import long_form


def _stats(rows: DataFrame, **aggs) -> DataFrame:
    """One row for each dimension: broadcast, as there are as many as components of a vector."""
    return F.broadcast(rows.groupBy("dim").agg(*[a.alias(n) for n, a in aggs.items()]))


def zscored(nodes: DataFrame) -> DataFrame:
    """``node_id, dim, v``: less the mean, by the sample deviation (0 counts as 1)."""
    rows = long_form(nodes)
    s = _stats(rows, m=F.avg("v"), s=F.stddev_samp("v"))
    return rows.join(s, "dim").select("node_id", "dim", ((F.col("v") - F.col("m")) / F.when(F.coalesce("s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("s"))).alias("v"))


def unscaled(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """The inverse, from ``dim, m, s``."""
    return rows.join(F.broadcast(stats), "dim").select("node_id", "dim", (F.col("v") * F.col("s") + F.col("m")).alias("v"))


def minmaxed(nodes: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """``node_id, dim, v``: from 0 to 1 over ``fit`` (or all); a constant column gives 0; what is not finite stays raw."""
    rows = long_form(nodes)
    s = _stats(long_form(fit) if fit is not None else rows, lo=F.min("v"), hi=F.max("v"))
    scaled = (F.col("v") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    return rows.join(s, "dim").select("node_id", "dim", F.when(bad, F.col("v")).otherwise(scaled).alias("v"))


def fidelity(real: DataFrame, made: DataFrame) -> DataFrame:
    """One row: mean absolute difference of column means, mean ratio of population deviations (the real one 1e-8 at least)."""
    a = long_form(real).groupBy("dim").agg(F.avg("v").alias("ma"), F.stddev_pop("v").alias("sa"))
    b = long_form(made).groupBy("dim").agg(F.avg("v").alias("mb"), F.stddev_pop("v").alias("sb"))
    return a.join(b, "dim").agg(F.avg(F.abs(F.col("mb") - F.col("ma"))).alias("bias"), F.avg(F.col("sb") / F.greatest("sa", F.lit(1e-8))).alias("std_ratio"))
