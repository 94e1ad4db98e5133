"""Group folds: a thing is never split over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.functions import twister
from ampwise.operators.align import substitute_degraded
from ampwise.operators.numbering import numbered
from ampwise.operators.ordering import MAX_GROUP_ROWS, find_hot, running
from ampwise.schema import EPISODE
from ampwise.session import small, stage

FOLD_SEED = 20091017
DEGRADED_FOLD_SEED = 4988


def thing_sizes(rows: DataFrame) -> DataFrame:
    """Episodes per thing."""
    return rows.select(*EPISODE).distinct().groupBy("thing").agg(F.count(F.lit(1)).alias("n"))


def seeded_order(seed: int) -> Column:
    """A pseudo-random order of things; pass an explicit order column where parity matters."""
    return F.xxhash64(F.col("thing"), F.lit(seed))


def fold_map(
    sizes: DataFrame,
    k: int,
    order: Column | None = None,
    seed: int = FOLD_SEED,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Fill folds greedily: a thing that would lift its fold above episodes/k opens the next one.

    With running totals known, the fill has only k-1 decisions: each opening is the first thing after the previous
    opening whose total, less what lay before that opening, exceeds the cap. Each is one minimum over the staged totals,
    and all that the driver sees is the k-1 openings.
    """
    order = seeded_order(seed) if order is None else order
    things = stage(sizes.select("thing", "n", order.alias("order"), F.lit(0).alias("_all")))
    hot = find_hot(things, ["_all"], max_rows)
    filled = stage(running(things, ["_all"], "order", ["thing"], {"upto": F.col("n")}, hot).drop("_all"))
    place = F.struct("order", "thing")
    first = F.min(F.struct(place.alias("place"), (F.col("upto") - F.col("n")).alias("before"))).alias("next")
    cap = filled.agg(F.floor(F.sum("n") / k)).first()[0]
    fold, before, last = F.lit(0), 0, None
    for _ in range(k - 1):
        beyond = F.col("upto") - before > cap
        opening = filled.where(beyond if last is None else beyond & (place > last)).agg(first).first()["next"]
        if opening is None:
            break
        before = opening["before"]
        order_type, thing_type = (filled.schema[c].dataType for c in ("order", "thing"))
        last = F.struct(F.lit(opening["place"]["order"]).cast(order_type).alias("order"), F.lit(opening["place"]["thing"]).cast(thing_type).alias("thing"))
        fold = fold + (place >= last).cast("int")
    return filled.select("thing", "n", "order", fold.alias("fold"))


def listed(things: DataFrame) -> DataFrame:
    """``thing`` with its ``item``, its place from 0 in the list of names."""
    named = things.select("thing").distinct().withColumn("_all", F.lit(0))
    return numbered(named, "_all", ["thing"], total="_n", index="item").select("thing", "item")


def stream_order(sizes: DataFrame, seed: int = FOLD_SEED) -> DataFrame:
    """``sizes`` with the ``place`` of each thing in the seeded permutation of the listed things, as a sequential run draws it."""
    items = listed(sizes)
    places = twister.permutation(sizes.sparkSession, items.count(), seed)
    return sizes.join(small(items.join(places, "item").select("thing", "place")), "thing")


def stream_fold_map(sizes: DataFrame, k: int, seed: int = FOLD_SEED) -> DataFrame:
    """``fold_map`` in the order that a sequential run with this seed takes the listed things."""
    return fold_map(stage(stream_order(sizes, seed)), k, F.col("place"))


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row inherits the fold of its thing; the map is broadcast when it is small enough."""
    return rows.join(small(folds.select("thing", "fold")), "thing")


def degraded_folds(
    rows: DataFrame,
    cuts: Sequence[tuple[float, int]],
    k: int,
    seed: int = DEGRADED_FOLD_SEED,
    order: Column | None = None,
    draw: Column | None = None,
    full: int = 100,
) -> DataFrame:
    """Folds of a population in which some episodes are replaced by their degraded version.

    Fold sizes count the healthy episodes; ``cuts`` are cumulative probabilities with the level they select.
    """
    folds = fold_map(thing_sizes(rows.where(F.col("soc") == full)), k, order, seed)
    return assign_folds(substitute_degraded(rows, cuts, seed, draw, full), folds)


def stream_degraded_folds(
    rows: DataFrame, cuts: Sequence[tuple[float, int]], k: int, seed: int = DEGRADED_FOLD_SEED, full: int = 100
) -> DataFrame:
    """``degraded_folds`` with the order and the draws of a sequential run: one draw per episode, things in their permuted
    order, after the permutation itself."""
    spark = rows.sparkSession
    healthy = stage(rows.where(F.col("soc") == full).select(*EPISODE).distinct())
    ordered = stage(stream_order(thing_sizes(healthy), seed))
    state = twister.after_permutation(spark, ordered.count(), seed)
    episodes = healthy.join(small(ordered.select("thing", "place")), "thing").withColumn("_all", F.lit(0))
    episodes = numbered(episodes, "_all", ["place", "month_idx", "ep_idx"], total="_n", index="draw")
    drawn = episodes.join(twister.draws(spark, episodes.count(), state), "draw").select(*EPISODE, "u")
    mixed = substitute_degraded(rows.join(drawn, EPISODE), cuts, seed, F.col("u"), full).drop("u")
    return assign_folds(mixed, fold_map(ordered, k, F.col("place")))


def fold_index(blow_rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold, thing and first timestamp of each episode."""
    starts = blow_rows.groupBy(*EPISODE).agg(F.min_by("ts", "blow_pos").alias("start_ts"))
    return assign_folds(starts, folds).select("fold", *EPISODE, "start_ts")


def leave_one_fold_out(spark: SparkSession, k: int) -> DataFrame:
    """One row per (split, fold) with the fold's role in that split."""
    role = F.when(F.col("split") == F.col("fold"), "valid").otherwise("train")
    return (
        spark.range(k)
        .select(F.col("id").cast("int").alias("split"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("role", role)
    )


def hold_out_role(fold: Column, k: int = 6) -> Column:
    """The last fold is held out for testing, the others are learned from."""
    return F.when(fold == k - 1, "test").otherwise("learn")


def search_role(fold: Column) -> Column:
    """The search leaves fold 0 aside, validates on fold 1 and trains on the rest."""
    return F.when(fold == 0, "unused").when(fold == 1, "valid").otherwise("train")
