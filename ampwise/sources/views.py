"""Telemetry and score views over general-purpose tables.

The operators are agnostic of the signal, so any keyed, timed, numeric table can stand in for a sensor. Each view
has the columns ``thing, ts, seq, current, voltage``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.operators.metrics import HEALTH_LEVELS
from ampwise.operators.ordering import find_hot, ordinal
from ampwise.operators.segment import find_hot_months
from ampwise.session import stage

CLOCK_START = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def events_telemetry(spark: SparkSession, folder: str, **limit) -> tuple[DataFrame, DataFrame | None]:
    """One thing per user on an irregular clock."""
    events = table(spark, folder, "events")
    telemetry = events.select(
        F.col("user_id").cast("string").alias("thing"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.round(F.lit(40) - F.col("value"), 2).alias("current"),
        F.col("value").alias("voltage"),
    )
    return telemetry, find_hot_months(telemetry, **limit)


def line_ticks(spark: SparkSession, folder: str, **limit) -> tuple[DataFrame, DataFrame | None]:
    """Line items numbered per supplier: the tick of a regular clock."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("thing"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
    )
    hot = find_hot(lines, ["thing"], **limit)
    ties = ["l_linenumber", "l_partkey", "l_extendedprice"]
    return ordinal(lines, ["thing"], "l_orderkey", ties, "tick", hot, start=1), hot


def _clocked(spark: SparkSession, folder: str, current, tick_s: int, staged: bool, limit: dict):
    ticks, hot_things = line_ticks(spark, folder, **limit)
    seconds = F.unix_timestamp(F.lit(CLOCK_START)) + F.col("tick") * tick_s
    telemetry = ticks.select(
        "thing",
        F.timestamp_seconds(seconds).alias("ts"),
        F.col("tick").alias("seq"),
        current.alias("current"),
        (F.lit(22.0) + F.col("l_discount") * 40.0 + F.col("l_quantity") / 10.0).alias("voltage"),
    )
    if staged:
        telemetry = stage(telemetry)
    # A month is part of a thing: without a hot thing no month is hot.
    return telemetry, None if hot_things is None else find_hot_months(telemetry, **limit)


def line_telemetry(spark: SparkSession, folder: str, tick_s: int = 1, staged: bool = False, **limit):
    """One thing per supplier, one row per tick, currents from -25 to 24.

    ``staged`` writes the numbered rows once, for pipelines that read them several times.
    """
    return _clocked(spark, folder, F.lit(25.0) - F.col("l_quantity"), tick_s, staged, limit)


def shaped_telemetry(spark: SparkSession, folder: str, tick_s: int = 1, staged: bool = False, **limit):
    """Supplier ticks shaped into a 40-tick rest, discharge, charge, rest cycle with occasional bumps."""
    phase = F.floor(F.pmod(F.col("tick"), F.lit(40)) / 10)
    level = F.when(phase == 0, 0).when(phase == 1, -20).when(phase == 2, 20).otherwise(1)
    bump = F.when(F.col("l_quantity") > 49, 9).otherwise(0)
    return _clocked(spark, folder, (level + bump).cast("double"), tick_s, staged, limit)


def order_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores ``(model, soc, sample_id, mae)``: one sample per order, five health levels, five models."""
    cents = F.round(F.col("o_totalprice") * 100.0).cast("long")
    base = (cents % 1000).cast("double") / 1000.0
    return (
        table(spark, folder, "orders")
        .withColumn("soc", F.explode(F.array(*[F.lit(s) for s in HEALTH_LEVELS])))
        .select(
            F.concat(F.lit("K_"), (1 + F.col("o_custkey") % 5).cast("string")).alias("model"),
            "soc",
            F.col("o_orderkey").alias("sample_id"),
            (base * (1.0 + (100 - F.col("soc")).cast("double") / 20.0)).alias("mae"),
        )
    )
