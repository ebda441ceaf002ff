"""Counters over result tables, collected while they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

EDGES = (0, 1, 2, 3, 5, 10, 20, 30)


def observed(rows: DataFrame, name: str = "jobs") -> tuple[DataFrame, Observation]:
    """rows, and what will be known of them after the first action: how many there are,
    how many succeeded and failed."""
    o = Observation(name)
    return rows.observe(o, F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors")), o


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """(low, n): values counted from each edge of 0, 1, 2, 3, 5, 10, 20, 30 on."""
    low = F.lit(EDGES[0])
    for e in EDGES[1:]:
        low = F.when(F.col(value) >= e, e).otherwise(low)
    return rows.where(F.col(value).isNotNull()).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))
