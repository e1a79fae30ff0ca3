"""A join of many rows with facts about their keys where some keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more rows than this, and than ``1 / MOST_HOT`` of all rows; so at most ``MOST_HOT`` keys are.
HOT_ROWS, MOST_HOT = 10_000, 1_000


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row for each key. Rows of hot keys stay
    where they are and meet the facts about at most ``MOST_HOT`` keys by broadcast; all others are
    shuffled by key. ``rows`` should be a table or cheap to compute, as it is read three times."""
    total = rows.count()
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    hot = counted.where(F.col("__n") > max(HOT_ROWS, total // MOST_HOT)).select(*keys).limit(MOST_HOT)
    few = F.broadcast(facts.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(facts, keys))
