"""Min-max scaling and sample arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows added to the data before fitting, as (current, voltage).
SENTINELS = {"current": (0.0, 0.0), "voltage": (22.0, 36.0)}


def fit_bounds(rows: DataFrame, columns: Sequence[str] = ("current", "voltage")) -> DataFrame:
    """One row with the lowest and highest value of each column, widened by the sentinels."""
    return rows.agg(
        *[
            F.least(F.min(c), *[F.lit(v) for v in SENTINELS.get(c, ())]).alias(f"{c}_lo")
            if c in SENTINELS
            else F.min(c).alias(f"{c}_lo")
            for c in columns
        ],
        *[
            F.greatest(F.max(c), *[F.lit(v) for v in SENTINELS.get(c, ())]).alias(f"{c}_hi")
            if c in SENTINELS
            else F.max(c).alias(f"{c}_hi")
            for c in columns
        ],
    )


def scaled(column: str) -> Column:
    """Map [lo, hi] to [-1, 1]; a constant column is only shifted and doubled."""
    lo, hi = F.col(f"{column}_lo"), F.col(f"{column}_hi")
    width = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return (F.col(column) - lo) * 2 / width - 1


def scale(rows: DataFrame, bounds: DataFrame, columns: Sequence[str] = ("current", "voltage")) -> DataFrame:
    """Scale columns in place. ``bounds`` is a single row, so broadcasting it is safe at any size."""
    kept = [scaled(c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(F.broadcast(bounds)).select(*kept)


def to_samples(rows: DataFrame, keys: Sequence[str], name: str = "x") -> DataFrame:
    """One array per blow: current and voltage of each position in turn. A blow has a fixed, small width."""
    step = F.struct("blow_pos", "current", "voltage")
    ordered = F.sort_array(F.collect_list(step))
    pairs = F.transform(ordered, lambda s: F.array(s["current"], s["voltage"]))
    return rows.groupBy(*keys).agg(F.flatten(pairs).alias(name))


def batch_compatible(
    samples: DataFrame, order: Sequence[str], batch: int, groups: Sequence[str] = ()
) -> DataFrame:
    """Drop the trailing ``n mod batch`` samples of each group in ``order``.

    Only the last ``batch`` rows per group are ranked (the rank limit applies before the shuffle); the rest passes
    through. The rows to drop are fewer than ``batch`` per group.
    """
    groups = list(groups)
    last = [F.desc(c) for c in order]
    if groups:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*last))
        tail = samples.select(*groups, *order).withColumn("_from_end", rank).where(F.col("_from_end") <= batch)
        sizes = samples.groupBy(*groups).agg((F.count(F.lit(1)) % batch).alias("_excess"))
        excess = tail.join(sizes, groups)
    else:
        tail = samples.select(*order).orderBy(*last).limit(batch)
        tail = tail.withColumn("_from_end", F.row_number().over(Window.orderBy(*last)))
        excess = tail.join(F.broadcast(samples.agg((F.count(F.lit(1)) % batch).alias("_excess"))))
    dropped = excess.where(F.col("_from_end") <= F.col("_excess")).select(*groups, *order)
    return samples.join(dropped if groups else F.broadcast(dropped), [*groups, *order], "left_anti")
