"""Ordered work inside groups when one group may hold a large share of all rows.

A window over a group runs in one task. That is the right plan while every group fits a task, so the largest
groups are measured first. Groups beyond ``max_rows`` are *hot*: they are cut into pieces along the order, each
piece is windowed on its own, and totals of the earlier pieces (one row per piece) are added back. Results are the
same either way.

Every group beyond the limit is hot, and is cut into ceil(rows / max_rows) pieces. Where the cuts lie is Spark's business: rows
of hot groups are dealt by ranges of the whole order. Tables with a row per piece or per hot group are broadcast while
``session.small`` finds them small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampwise.session import SMALL_ROWS, small, stage

MAX_GROUP_ROWS = 2_000_000
MEASURE = "measure"


def find_hot(
    df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS, pieces: int | None = None
) -> DataFrame | None:
    """The hot groups of ``df`` with the number of their ``_pieces``, or None when no group exceeds ``max_rows``.

    One map-side combined count decides. A group gets as many pieces as its rows need, or ``pieces`` if given. A short list
    is held as it is, a longer one is staged.
    """
    keys = list(keys)
    wanted = F.ceil(F.col("_rows") / max_rows).cast("int") if pieces is None else F.lit(pieces)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_rows)
    largest = largest.select(*keys, wanted.alias("_pieces"))
    rows = largest.limit(SMALL_ROWS + 1).collect()
    if not rows:
        return None
    return stage(largest) if len(rows) > SMALL_ROWS else df.sparkSession.createDataFrame(rows, largest.schema)


def measured(df: DataFrame, keys: Sequence[str], hot, max_rows: int) -> DataFrame | None:
    """``hot`` as given, or measured on ``df`` when it is MEASURE.

    Groups found on a table are hot for any subset of its rows, so callers measure once and pass the result on.
    """
    return find_hot(df, keys, max_rows) if isinstance(hot, str) and hot == MEASURE else hot


def dealt_in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_hot`` and ``_piece``: 0 for ordinary groups; rows of hot ones are dealt by ranges of (keys, order), staged, and
    numbered by their range, so that equal values of the order may be split too. A group's pieces are consecutive numbers."""
    keys = list(keys)
    named = small(hot.select(*keys))
    ordinary = df.join(named, keys, "left_anti").select(*df.columns, F.lit(0).alias("_piece"), F.lit(False).alias("_hot"))
    count = hot.agg(F.sum("_pieces")).first()[0]
    ranged = df.join(named, keys, "left_semi").select(*df.columns).repartitionByRange(count, *keys, *order)
    split = stage(ranged.select("*", F.spark_partition_id().alias("_piece"), F.lit(True).alias("_hot")))
    return ordinary.unionByName(split)


def earlier_pieces(
    pieces: DataFrame,
    keys: Sequence[str],
    totals: dict[str, Column],
    fold: str = "sum",
    later: bool = False,
) -> DataFrame:
    """Per hot piece, the fold of ``totals`` over all earlier (or later) pieces of its group."""
    keys = list(keys)
    per_piece = pieces.where("_hot").groupBy(*keys, "_piece").agg(*[c.alias(name) for name, c in totals.items()])
    order = F.desc("_piece") if later else F.asc("_piece")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    folded = {"sum": F.sum, "max": F.max, "min": F.min}[fold]
    return per_piece.select(*keys, "_piece", *[folded(name).over(before).alias(name) for name in totals])


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie_break: Sequence[str],
    sums: dict[str, Column],
    hot: DataFrame | None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums of integer columns along (position, tie_break) inside each group.

    Rows of hot groups are range-partitioned on the whole order, so rows with equal positions are split by the
    tie-break: no value of ``position`` is too frequent. Only rows equal in both stay together.
    """
    keys = list(keys)
    order = [F.desc(position) if descending else F.asc(position)] + [F.asc(c) for c in tie_break]

    def along(*groups: str) -> Window:
        return Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def summed(rows: DataFrame, *groups: str) -> DataFrame:
        return rows.select("*", *[F.sum(c).over(along(*groups)).alias(name) for name, c in sums.items()])

    if hot is None:
        return summed(df, *keys)
    named = small(hot.select(*keys))
    ordinary = summed(df.join(named, keys, "left_anti").select(*df.columns), *keys)
    pieces = hot.agg(F.sum("_pieces")).first()[0]
    ranged = df.join(named, keys, "left_semi").select(*df.columns).repartitionByRange(pieces, *keys, *order)
    split = stage(ranged.select("*", F.spark_partition_id().alias("_piece"), F.lit(True).alias("_hot")))
    carried = earlier_pieces(split, keys, {f"_before_{name}": F.sum(c) for name, c in sums.items()})
    joined = summed(split, *keys, "_piece").join(small(carried), [*keys, "_piece"], "left")
    totals = [
        (F.col(name) + F.coalesce(F.col(f"_before_{name}"), F.lit(0))).alias(name) for name in sums
    ]
    return ordinary.unionByName(joined.select(*df.columns, *totals))


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie_break: Sequence[str],
    name: str,
    hot: DataFrame | None,
    start: int = 0,
) -> DataFrame:
    """Number the rows of each group along (position, tie_break), from ``start``."""
    if hot is None:
        window = Window.partitionBy(*keys).orderBy(position, *tie_break)
        return df.withColumn(name, (F.row_number().over(window) - 1 + start).cast("long"))
    numbered = running(df, keys, position, tie_break, {name: F.lit(1)}, hot)
    return numbered.withColumn(name, (F.col(name) - 1 + start).cast("long"))
