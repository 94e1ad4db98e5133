"""Exact interpolated percentiles, with a distributed path for groups too large for one aggregation buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampwise.operators.ordering import MAX_GROUP_ROWS, MEASURE, measured, running
from ampwise.session import small


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    hot: DataFrame | str | None = MEASURE,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per group, an array ``values`` of the percentiles at ``fractions``, interpolated linearly.

    The built-in exact percentile keeps a group's distinct values in one buffer. Where the largest group is too large
    for that, its values are counted, ranked along ``value``, and only the few needed ranks are kept. ``hot=None`` states that every
    group is known to be small.
    """
    keys = list(keys)
    fractions = [float(f) for f in fractions]
    present = df.select(*keys, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull())
    if not keys:
        keys = ["_all"]
        present = present.withColumn("_all", F.lit(0))
    hot = measured(present, keys, hot, max_rows)
    if hot is None:
        out = present.groupBy(*keys).agg(F.percentile("_value", fractions).alias("values"))
    else:
        out = _by_rank(present, keys, fractions, hot)
    return out.drop("_all")


def _by_rank(present: DataFrame, keys: list[str], fractions: list[float], hot: DataFrame) -> DataFrame:
    """Equal values are counted first, so a frequent value is one row with the range of ranks it covers."""
    counted = present.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = running(counted, keys, "_value", [], {"_upto": F.col("_rows")}, hot)
    sizes = counted.groupBy(*keys).agg(F.sum("_rows").alias("_n"))
    places = F.array(*[F.lit(f) for f in fractions])
    place = F.transform(places, lambda f: f * (F.col("_n") - 1))
    needed = F.array_distinct(
        F.flatten(F.transform(place, lambda h: F.array(F.floor(h), F.ceil(h))))
    )
    covers = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_rows"))
    kept = ranked.join(small(sizes), keys).withColumn("_ranks", F.filter(needed, covers)).where(F.size("_ranks") > 0)
    found = kept.select(*keys, "_n", "_value", F.explode("_ranks").alias("_rank")).groupBy(*keys, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")
    )

    def interpolate(h):
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.ceil(h)]
        return low + (high - low) * (h - F.floor(h))

    return found.select(*keys, F.transform(place, interpolate).alias("values"))


def named_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float], hot: DataFrame | str | None = MEASURE
) -> DataFrame:
    """Percentiles as columns."""
    out = percentiles(df, keys, value, list(names.values()), hot)
    return out.select(*keys, *[F.col("values")[i].alias(name) for i, name in enumerate(names)])


def threshold_table(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], hot: DataFrame | str | None = MEASURE
) -> DataFrame:
    """Percentiles as rows ``(keys, pct, threshold)``."""
    out = percentiles(df, keys, value, [p / 100 for p in percents], hot)
    labels = F.array(*[F.lit(int(p)) for p in percents])
    zipped = F.arrays_zip(labels.alias("pct"), F.col("values").alias("threshold"))
    return out.select(*keys, F.inline(zipped))
