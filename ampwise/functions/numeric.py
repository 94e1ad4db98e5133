"""Numeric expressions: losses, errors, seeded draws, simulator parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The simulator's full-health battery parameters.
SIMULATOR_PARAMETERS = {
    "max_capacity": 386,
    "discharge_rate": 68,
    "normal_operating": 326,
    "exponential_zone": 95,
    "nominal_capacity": 340,
}


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    return F.when(size < delta, F.lit(0.5) * error * error).otherwise(F.lit(delta) * (size - 0.5 * delta))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def array_mae(left: Column, right: Column) -> Column:
    """Mean absolute difference of two equally long arrays."""
    return mean_of(F.zip_with(left, right, lambda a, b: F.abs(a - b)))


def array_huber(left: Column, right: Column, delta: float = 1.0) -> Column:
    return mean_of(F.zip_with(left, right, lambda a, b: huber(a - b, delta)))


def sparse_loss(left: Column, right: Column, code: Column) -> Column:
    """Mean Huber error plus mean absolute code."""
    return array_huber(left, right) + mean_of(F.transform(code, lambda c: F.abs(c)))


def uniform(*parts: Column, seed: int) -> Column:
    """A draw in [0, 1) that depends on the key and the seed only, never on the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def half_away_int(value: Column) -> Column:
    return F.round(value).cast("int")


def aged_parameters(soc: Column) -> dict[str, Column]:
    return {name: half_away_int(F.lit(full) * soc / F.lit(100)) for name, full in SIMULATOR_PARAMETERS.items()}


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def f_score(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_rank(df: DataFrame, sorted_values: str, value: Column, name: str, max_length: int) -> DataFrame:
    """Add how many entries of a sorted array column are <= ``value``; 0 for a null array.

    A binary search unrolled into projections, so it stays in generated code and costs log2(length) comparisons.
    """
    out = df.withColumns({"_sought": value, name: F.lit(0)})
    step = 1 << max(max_length.bit_length() - 1, 0)
    while step:
        probe = F.get(sorted_values, F.col(name) + (step - 1))
        out = out.withColumn(name, F.col(name) + F.when(probe <= F.col("_sought"), step).otherwise(0))
        step >>= 1
    return out.drop("_sought")
