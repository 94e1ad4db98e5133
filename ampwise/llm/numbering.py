"""Numbers without gaps for the rows of a large table, without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampwise.session import small, stage

PART_BITS = 33  # of a row's place in its partition, in the ids that Spark hands out


def _counted(rows: DataFrame, group: str, total: str, index: str) -> DataFrame:
    """Rows of a group follow each other in every partition, so a partition's count and first id place them all."""
    placed = stage(rows.withColumn("_seq", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_seq", PART_BITS))
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    whole = Window.partitionBy(group)
    earlier = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        group, "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias(total)
    )
    joined = placed.join(small(offsets), [group, "_part"])
    return joined.select(*rows.columns, total, (F.col("_before") + F.col("_seq") - F.col("_first")).alias(index))


def numbered(rows: DataFrame, group: str, order: Sequence[str], total: str = "n", index: str = "index") -> DataFrame:
    """``rows`` with the size of their group (a column without nulls) and their place from 0 in it along ``order``.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks, and staged; only the counts
    by group and partition are windowed. Rows that tie in ``order`` are numbered in any order.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    return _counted(ranged, group, total, index)


def indexed(rows: DataFrame, index: str = "index") -> DataFrame:
    """``rows`` staged, numbered from 0 as they lie; nothing is shuffled."""
    return _counted(rows.withColumn("_all", F.lit(0)), "_all", "_n", index).drop("_all", "_n")
