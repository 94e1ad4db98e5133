"""Fixed-width samples around the first discharge and the first charge of an episode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampwise.functions.signal import is_charge, is_discharge
from ampwise.schema import EPISODE, Params


def _from_end_if_negative(start: Column, rows: Column) -> Column:
    """A negative slice start counts from the end of the episode, as in the sliced frames of the data model."""
    return F.when(start < 0, F.greatest(start + rows, F.lit(0))).otherwise(start)


def anchors(episode: DataFrame, p: Params, one_pass: bool = True) -> DataFrame:
    """Add per row: episode length and positions of its first discharge and first charge row.

    ``one_pass`` windows over the episode, which is how its rows are already distributed; without it the three
    numbers are aggregated map-side and joined back, for episodes too long for one task.
    """
    stats = {
        "ep_rows": F.count(F.lit(1)),
        "first_dis": F.min(F.when(is_discharge(p), F.col("pos"))),
        "first_chg": F.min(F.when(is_charge(p), F.col("pos"))),
    }
    if one_pass:
        whole = Window.partitionBy(*EPISODE)
        return episode.select("*", *[c.over(whole).alias(name) for name, c in stats.items()])
    per_episode = episode.groupBy(*EPISODE).agg(*[c.alias(name) for name, c in stats.items()])
    return episode.join(per_episode, EPISODE)


def with_windows(anchored: DataFrame, p: Params) -> DataFrame:
    """Add the positions of both parts, ``d_lo <= pos < d_hi`` and ``c_lo <= pos < c_hi``.

    Needs the episode's length and first positions; episodes lacking a state, or with an empty part, give no rows.
    """
    rows, d, c = F.col("ep_rows"), F.col("first_dis"), F.col("first_chg")
    bounded = anchored.where(d.isNotNull() & c.isNotNull()).withColumns(
        {
            "d_lo": _from_end_if_negative(d - p.eps1, rows),
            "d_hi": F.least(d + p.alpha1, rows),
            "c_lo": _from_end_if_negative(c - p.alpha1, rows),
            "c_hi": F.least(c + p.alpha2, rows),
        }
    )
    return bounded.where((F.col("d_lo") < F.col("d_hi")) & (F.col("c_lo") < F.col("c_hi")))


def extract_blows(episode: DataFrame, p: Params, one_pass: bool = True) -> DataFrame:
    """Rows of both parts; overlapping rows appear in each part.

    ``part`` is discharge or charge, ``part_pos`` numbers rows inside the part (pair form) and ``blow_pos`` inside the
    joined blow. Episodes lacking a state, or with an empty part, give no rows.
    """
    bounded = with_windows(anchors(episode, p, one_pass), p)
    pos = F.col("pos")
    in_d = (pos >= F.col("d_lo")) & (pos < F.col("d_hi"))
    in_c = (pos >= F.col("c_lo")) & (pos < F.col("c_hi"))
    of_d = F.struct(
        F.lit("discharge").alias("part"),
        (pos - F.col("d_lo")).cast("int").alias("part_pos"),
        (pos - F.col("d_lo")).cast("int").alias("blow_pos"),
    )
    of_c = F.struct(
        F.lit("charge").alias("part"),
        (pos - F.col("c_lo")).cast("int").alias("part_pos"),
        (pos - F.col("c_lo") + F.col("d_hi") - F.col("d_lo")).cast("int").alias("blow_pos"),
    )
    roles = F.filter(F.array(F.when(in_d, of_d), F.when(in_c, of_c)), lambda role: role.isNotNull())
    return bounded.where(in_d | in_c).select(*episode.columns, F.inline(roles))


def in_months(rows: DataFrame, month_indexes: Sequence[int]) -> DataFrame:
    """Rows of the listed months, ``month_order`` following the list; an empty list keeps every month."""
    if not month_indexes:
        return rows.withColumn("month_order", F.col("month_idx"))
    listed = F.array(
        *[F.struct(F.lit(i).alias("month_order"), F.lit(m).alias("wanted")) for i, m in enumerate(month_indexes)]
    )
    hits = F.filter(listed, lambda entry: entry["wanted"] == F.col("month_idx"))
    chosen = rows.where(F.col("month_idx").isin(list(month_indexes)))
    return chosen.select("*", F.inline(hits)).drop("wanted")


def drop_odd_widths(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Keep blows of exactly ``width`` rows."""
    counted = rows.withColumn("_width", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.col("_width") == width).drop("_width")
