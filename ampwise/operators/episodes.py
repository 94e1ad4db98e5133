"""Episode rows, summaries of the episode set, and samples of it for inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampwise.operators.ordering import dealt_in_pieces, earlier_pieces
from ampwise.operators.segment import candidates, headers, months
from ampwise.schema import EPISODE, MONTH, Params

BLOCK_ROWS = 64


def episode_rows(
    telemetry: DataFrame, episode_headers: DataFrame, p: Params, hot: DataFrame | None = None
) -> DataFrame:
    """All columns of the rows of each episode, with their 0-based position.

    A range join on the row order, made an equi-join by cutting time into blocks of BLOCK_ROWS nominal rows. Keys are
    (thing, month, block), so no thing is hot, and a header meets only rows of the blocks it spans. The headers of a
    partition are hashed and the rows stream past them, neither sorted nor sent to the driver: files of rows are far smaller
    than the rows, so Spark's estimate of them must not decide on a broadcast.
    """
    block_us = BLOCK_ROWS * p.period_s * 1_000_000
    block = F.floor(F.col("us") / F.lit(block_us))
    rows = telemetry.withColumns(
        {"year": F.year("ts"), "month": F.month("ts"), "us": F.unix_micros("ts")}
    ).withColumn("block", block)
    spans = episode_headers.select(
        *MONTH,
        "month_idx",
        "ep_idx",
        "from_us",
        "from_seq",
        "to_us",
        "to_seq",
        F.explode(
            F.sequence(F.floor(F.col("from_us") / block_us), F.floor(F.col("to_us") / block_us))
        ).alias("block"),
    )
    us, seq = F.col("us"), F.col("seq")
    begun = (us > F.col("from_us")) | ((us == F.col("from_us")) & (seq >= F.col("from_seq")))
    ended = (us > F.col("to_us")) | ((us == F.col("to_us")) & (seq >= F.col("to_seq")))
    inside = rows.join(spans.hint("shuffle_hash"), [*MONTH, "block"]).where(begun & ~ended)
    inside = inside.drop("from_us", "from_seq", "to_us", "to_seq", "block")
    if hot is None:
        along = Window.partitionBy(*EPISODE).orderBy("us", "seq")
        numbered = inside.withColumn("pos", F.row_number().over(along) - 1)
    else:
        split = dealt_in_pieces(inside, MONTH, ["us", "seq"], hot)
        along = Window.partitionBy(*EPISODE, "_piece").orderBy("us", "seq")
        carried = earlier_pieces(split, EPISODE, {"_earlier": F.count(F.lit(1))})
        numbered = (
            split.withColumn("pos", F.row_number().over(along) - 1)
            .join(carried, [*EPISODE, "_piece"], "left")
            .withColumn("pos", (F.col("pos") + F.coalesce("_earlier", F.lit(0))).cast("int"))
            .drop("_earlier", "_piece", "_hot")
        )
    return numbered.drop("us")


def find_episodes(
    telemetry: DataFrame, p: Params, mode: str = "swab2swab", hot: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Headers and rows of all valid episodes of clean telemetry."""
    found = candidates(telemetry, p, mode, hot)
    heads = headers(found, months(telemetry), in_pieces=hot is not None)
    return heads, episode_rows(telemetry, heads, p, hot)


def lengths(episode_headers: DataFrame, p: Params) -> DataFrame:
    """Rows per episode, known from the header alone."""
    return episode_headers.select(*EPISODE, (F.col("end_rn") - F.col("start_rn") + p.eps1).alias("rows"))


def summary(episode_lengths: DataFrame, month_table: DataFrame) -> DataFrame:
    """Episode counts and lengths per (thing, month), thing, month and overall.

    Months without an episode count 0 with null lengths. ``level`` names the grouping set.
    """
    all_months = month_table.select("thing", "month_idx")
    joined = all_months.join(episode_lengths, ["thing", "month_idx"], "left")
    sets = [("thing", "month_idx"), ("thing",), ("month_idx",), ()]
    grouped = joined.groupingSets(sets, "thing", "month_idx").agg(
        F.grouping_id().alias("gid"),
        F.count("rows").alias("episodes"),
        F.countDistinct("thing").alias("things"),
        F.avg("rows").alias("mean_rows"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
    )
    names = F.when(F.col("gid") == 0, "thing_month").when(F.col("gid") == 1, "thing")
    level = names.when(F.col("gid") == 2, "month").otherwise("all")
    return grouped.select(level.alias("level"), "thing", "month_idx", *grouped.columns[3:])


def episode_counts(keyed: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Distinct episodes per thing with the overall total (null thing)."""
    return keyed.select(*keys).distinct().rollup("thing").agg(F.count(F.lit(1)).alias("episodes"))


def first_of_month(episode_headers: DataFrame, month_idx: int, limit: int | None = 1) -> DataFrame:
    """The first ``limit`` episodes per thing in one month; None keeps all."""
    chosen = episode_headers.where(F.col("month_idx") == month_idx)
    if limit is None:
        return chosen
    # ep_idx counts from 0 without holes inside a month, so the rank is already there.
    return chosen.where(F.col("ep_idx") < limit)


def month_counts(episode_headers: DataFrame, month_idx: int) -> DataFrame:
    """Episodes per thing in one month, and their total (null thing)."""
    chosen = episode_headers.where(F.col("month_idx") == month_idx)
    return chosen.rollup("thing").agg(F.count(F.lit(1)).alias("episodes"))


def thing_names(episode: DataFrame, name: str = "THING") -> DataFrame:
    """Name of each thing: on the first row of the first episode of its last month with episodes."""
    first = (F.col("ep_idx") == 0) & (F.col("pos") == 0)
    return episode.where(first).groupBy("thing").agg(F.max_by(name, "month_idx").alias("name"))
