"""Places and running sums in a total order, without one task that holds all rows: rows are sorted over
all tasks and written; one row for each partition then says what lies before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialize


def running_sums(rows: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over this row and all before it. The order
    should be total, else rows that tie come in any order."""
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = materialize(rows.orderBy(*keys).withColumn("__p", F.spark_partition_id()), "sorted")
    whole = placed.groupBy("__p").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = whole.select("__p", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    here = W.partitionBy("__p").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(starts), "__p")
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"__{n}") + F.sum(c).over(here))
    return out.drop("__p", *[f"__{n}" for n in sums])


def numbered(rows: DataFrame, *order: Column | str, name: str = "r") -> DataFrame:
    """``rows`` with their place from 1 in a total order."""
    return running_sums(rows, list(order), **{name: F.lit(1).cast("long")})


def numbered_within(rows: DataFrame, group: str, *order: Column | str, name: str = "r", size: str = "n") -> DataFrame:
    """``rows`` with their place from 1 inside their group, and the group's size; for groups that may hold
    most rows. Groups are few: what is joined back is a row for each."""
    placed = numbered(rows, F.col(group).asc_nulls_first(), *order, name="__r")
    groups = placed.groupBy(group).agg((F.min("__r") - 1).alias("__first"), F.count("*").alias(size))
    return placed.withColumnRenamed(group, "__g").join(groups, F.col("__g").eqNullSafe(F.col(group))).withColumn(name, F.col("__r") - F.col("__first")).drop("__g", "__r", "__first")


def first_rows(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in a total order, as a sort and a limit give them; a limit reads all it keeps in one task, here a task
    reads no more than one partition of the sorted table."""
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = materialize(rows.orderBy(*keys).withColumn("__p", F.spark_partition_id()), "sorted")
    left, border = n, -1
    for part in sorted(placed.groupBy("__p").count().collect()):  # a row for each partition
        border = part[0]
        if part[1] >= left:
            break
        left -= part[1]
    whole = placed.where(F.col("__p") < border)
    return whole.unionByName(placed.where(F.col("__p") == border).orderBy(*keys).limit(left)).drop("__p")
