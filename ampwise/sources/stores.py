"""Parquet stores for episodes, blows, scores and curves."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.session import small, stage
from ampwise.sources import snapshots
from ampwise.sources.telemetry_csv import is_folder

log = logging.getLogger(__name__)

EPISODES_PER_FILE = 4096
# Things are dealt over so many folders: a folder per thing would cost more than its rows where things are many.
SHARD, SHARDS = "thing_shard", 128
MIXED_AGE_MAX_THINGS = 31
# Last listing rank (from 1) at each health level of the mixed-age set.
MIXED_AGE_RANKS = [(15, 100), (23, 95), (27, 90), (29, 85), (30, 80), (31, 75)]


def _shard(thing: Column) -> Column:
    return F.pmod(F.xxhash64(thing), F.lit(SHARDS)).cast("int")


def save_episodes(rows: DataFrame, months: DataFrame, path: str, with_episodes: DataFrame | None = None) -> None:
    """Store episode rows by shards of things, sorted by thing. The months also record things without any episode.

    A shard's rows are spread by month and episode range, so a large thing becomes several files, not one task. Rows and
    months appear together or not at all, in place of what was stored for the same things. ``with_episodes`` names the
    things that have rows, where that is cheaper to know than from the stored rows.
    """

    def stored(written: dict[str, DataFrame]) -> DataFrame:
        filled = (written["rows"] if with_episodes is None else with_episodes).select("thing").distinct()
        things = written["months"].select("thing").distinct()
        marked = things.join(filled.withColumn("has_episodes", F.lit(True)), "thing", "left")
        return marked.fillna(False, ["has_episodes"])

    spread = F.floor(F.col("ep_idx") / EPISODES_PER_FILE)
    sharded = rows.withColumn(SHARD, _shard(F.col("thing")))
    sorted_rows = sharded.repartition(SHARD, "month_idx", spread).sortWithinPartitions(
        SHARD, "thing", "month_idx", "ep_idx", "pos"
    )
    snapshots.commit(path, ["thing"], stored, {"rows": (sorted_rows, [SHARD]), "months": (months, [])})


def stored_things(spark: SparkSession, path: str) -> DataFrame | None:
    """Things already built; None for a store that does not exist."""
    found = snapshots.entries(spark, path)
    return None if found is None else found.select("thing")


def load_episodes(spark: SparkSession, path: str, thing: str | None = None) -> DataFrame | None:
    """All episodes, or those of one thing from its shard alone. A missing store or thing gives None and a warning."""
    rows = snapshots.read(spark, path, "rows", ["thing"])
    if rows is None:
        log.warning("no episodes at %s, build the data set first", path)
        return None
    if thing is not None:
        rows = rows.where((F.col(SHARD) == _shard(F.lit(thing))) & (F.col("thing") == thing))
        if rows.select(F.lit(1)).limit(1).isEmpty():
            log.warning("no episodes of %s at %s", thing, path)
            return None
    return rows.drop(SHARD)


def load_months(spark: SparkSession, path: str) -> DataFrame:
    """Months of all stored things, and whether the thing has episodes."""
    months = snapshots.read(spark, path, "months", ["thing"])
    return months.join(small(snapshots.entries(spark, path)), "thing")


def save_blows(blows: DataFrame, path: str) -> None:
    """Store synthetic blows by health level and shard of things, in place of what was stored for the same levels and things."""
    spread = F.floor(F.col("ep_idx") / EPISODES_PER_FILE)
    sharded = blows.withColumn(SHARD, _shard(F.col("thing")))
    sorted_rows = sharded.repartition("soc", SHARD, "month_idx", spread).sortWithinPartitions(
        "soc", SHARD, "thing", "month_idx", "ep_idx", "blow_pos"
    )
    stored = lambda written: written["blows"].select("soc", "thing").distinct()
    snapshots.commit(path, ["soc", "thing"], stored, {"blows": (sorted_rows, ["soc", SHARD])})


def load_blows(spark: SparkSession, path: str, soc: int | None = None) -> DataFrame:
    rows = snapshots.read(spark, path, "blows", ["thing"])
    if rows is None:
        raise ValueError(f"no synthetic blows at {path}, import them first")
    return (rows if soc is None else rows.where(F.col("soc") == soc)).drop(SHARD)


def mixed_age(blows: DataFrame, beyond: int | None = None) -> DataFrame:
    """Each thing at the health level its name rank selects.

    The staircase is defined for 31 things. Things behind them take the level ``beyond``; without one they are refused.
    """
    listed = blows.where(F.col("soc") == 100).select("thing").distinct()
    names = [r.thing for r in listed.orderBy("thing").limit(MIXED_AGE_MAX_THINGS + 1).collect()]
    if len(names) > MIXED_AGE_MAX_THINGS and beyond is None:
        raise ValueError(f"the mixed-age set is defined for at most {MIXED_AGE_MAX_THINGS} things")
    levels = [
        (thing, next(soc for last, soc in MIXED_AGE_RANKS if rank <= last))
        for rank, thing in enumerate(names[:MIXED_AGE_MAX_THINGS], start=1)
    ]
    staircase = F.broadcast(blows.sparkSession.createDataFrame(levels, "thing string, _level int"))
    leveled = blows.join(staircase, "thing", "left").where(F.col("soc") == F.coalesce("_level", F.lit(beyond)))
    return leveled.drop("_level")


def save_evaluation(path: str, scores: DataFrame, thresholds: DataFrame, models: DataFrame | None = None) -> None:
    """Scores of the best model at every health level, its thresholds, and the models as rows, in one step.

    What was stored for a model is replaced by what is given for it, in all three tables.
    """
    given = {"scores": scores, "thresholds": thresholds} | ({} if models is None else {"models": models})
    given = {name: stage(table) for name, table in given.items()}
    stored = reduce(DataFrame.union, [table.select("model") for table in given.values()])
    snapshots.commit(path, ["model"], stored, {name: (table, ["model"]) for name, table in given.items()})


def load_evaluation(spark: SparkSession, path: str, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    tables = [snapshots.read(spark, path, name, ["model"]) for name in ("scores", "thresholds")]
    if model is not None:
        tables = [t.where(F.col("model") == model) for t in tables]
    return tables[0], tables[1]


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Models stored with an evaluation; ``reconstruct.models_from_table`` makes them usable again."""
    return snapshots.read(spark, path, "models", ["model"])


def cached_table(spark: SparkSession, path: str, build, force: bool = True) -> DataFrame:
    """Return the stored table, building it first when absent or forced."""
    if force or not is_folder(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_history(history: DataFrame, path: str) -> None:
    """Training history rows ``(model, epoch, metric, value)``."""
    history.write.mode("append").partitionBy("model").parquet(path)


def learning_curve(history: DataFrame, stride: int = 50, train_stride: int = 500, epochs: int = 400) -> DataFrame:
    """Every ``stride``-th validation loss and ``train_stride``-th training loss of the first epochs."""
    validation = (F.col("metric") == "val_loss") & (F.col("epoch") % stride == 0)
    training = (F.col("metric") == "loss") & (F.col("epoch") % train_stride == 0)
    return history.where((F.col("epoch") < epochs) & (validation | training))
