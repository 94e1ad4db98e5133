"""How many distinct values the two signals take, and their range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolution(rows: DataFrame, columns: Sequence[str] = ("voltage", "current"), by: Sequence[str] = ()) -> DataFrame:
    """Row count, and per column the number of distinct values, minimum and maximum.

    Values are deduplicated map-side; a second small aggregation counts them. That costs one shuffle of the distinct
    values instead of one expanded copy of all rows per distinct count.
    """
    pairs = [F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in columns]
    per_value = (
        rows.select(*by, F.inline(F.array(*pairs)))
        .groupBy(*by, "signal", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_value.groupBy(*by, "signal").agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
