"""The event stream in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import table
from ..streaming.events import activity
from .catalog import query


@query("event_activity", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_activity(spark, d):
    found = activity(table(spark, d, "events"))
    return found.select(F.to_date("day").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
