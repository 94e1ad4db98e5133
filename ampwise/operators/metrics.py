"""Detection metrics on scored samples.

Scores are rows ``(model, soc, sample_id, mae)``. A sample at health 95 or 100 is healthy, below that degraded; it is
flagged when its error reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampwise.functions import twister
from ampwise.functions.numeric import bind, f_score, ratio, uniform, with_rank
from ampwise.functions.signal import count_where
from ampwise.operators.numbering import numbered
from ampwise.operators.ordering import MAX_GROUP_ROWS, MEASURE, find_hot, measured, running
from ampwise.operators.quantiles import named_percentiles, percentiles, threshold_table
from ampwise.session import small, stage

# Scored health levels, threshold percentiles and population cuts (draw >= cut selects the level).
HEALTH_LEVELS = [100, 95, 90, 85, 80]
HEALTHY = [100, 95]
PERCENTS = list(range(10, 100))
BOX_PERCENT = 87
SWEEP_POPULATION = [(0.90, 80), (0.80, 85), (0.70, 90), (0.25, 95)]
MAP_POPULATION = [(0.95, 80), (0.85, 85), (0.75, 90), (0.35, 95)]
POPULATION_SEED = 42
INTERVENTIONS = 150


def is_degraded(soc: str = "soc") -> Column:
    return ~F.col(soc).isin(HEALTHY)


def quartiles(scores: DataFrame, hot: DataFrame | str | None = MEASURE) -> DataFrame:
    return named_percentiles(scores, ["soc"], "mae", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, hot)


def box_stats(
    df: DataFrame, keys: Sequence[str], value: str, fences: bool = False, hot: DataFrame | str | None = MEASURE
) -> DataFrame:
    """Quartiles with whiskers at the 10th and 90th percentile, or at the furthest values within 1.5 IQR."""
    names = {"p10": 0.1, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9}
    if not fences:
        return named_percentiles(df, keys, value, names, hot)
    boxes = small(named_percentiles(df, keys, value, {n: names[n] for n in ("q1", "q2", "q3")}, hot))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low_side = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q1"))
    high_side = (F.col(value) <= F.col("q3") + reach) & (F.col(value) >= F.col("q3"))
    whiskers = (
        df.join(boxes, list(keys))
        .groupBy(*keys)
        .agg(
            F.min(F.when(low_side, F.col(value))).alias("low"),
            F.max(F.when(high_side, F.col(value))).alias("high"),
        )
    )
    joined = boxes.join(whiskers, list(keys))
    return joined.select(
        *keys, F.coalesce("low", "q1").alias("low"), "q1", "q2", "q3", F.coalesce("high", "q3").alias("high")
    )


def model_summary(scores: DataFrame, hot: DataFrame | str | None = MEASURE) -> DataFrame:
    """Mean, population deviation and tail percentiles per model."""
    names = {"p3": 0.03, "p10": 0.1, "p90": 0.9, "p95": 0.95, "p97": 0.97}
    spread = scores.groupBy("model").agg(
        F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"), F.count(F.lit(1)).alias("samples")
    )
    return spread.join(named_percentiles(scores, ["model"], "mae", names, hot), "model")


def best_model(scores: DataFrame) -> DataFrame:
    """The model of lowest mean error; the first name wins a tie. No row without scores."""
    means = scores.groupBy("model").agg(F.avg("mae").alias("mean_mae"))
    best = F.min(F.struct("mean_mae", "model")).alias("best")
    return means.agg(best).where(F.col("best").isNotNull()).select("best.model", "best.mean_mae")


def thresholds(
    scores: DataFrame, percents: Sequence[int] = tuple(PERCENTS), hot: DataFrame | str | None = MEASURE
) -> DataFrame:
    return threshold_table(scores, ["model"], "mae", percents, hot)


def percentile_threshold(scores: DataFrame, percent: int, hot: DataFrame | str | None = MEASURE) -> DataFrame:
    """One threshold per model from full-health errors."""
    full = scores.where(F.col("soc") == 100)
    out = percentiles(full, ["model"], "mae", [percent / 100], hot)
    return out.select("model", F.lit(percent).alias("pct"), F.col("values")[0].alias("threshold"))


def confusion(scores: DataFrame, threshold_rows: DataFrame, degraded: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn per (model, pct, threshold).

    No sample meets every threshold. Each sample is ranked among its model's thresholds and counted once per rank;
    running totals over the ranks give the counts at every threshold. The search is as deep as the longest ladder needs.
    """
    degraded = is_degraded() if degraded is None else degraded
    collected = F.array_sort(F.collect_list(F.struct("threshold", "pct")))
    listed = small(threshold_rows.groupBy("model").agg(collected.alias("_listed")))
    longest = listed.agg(F.max(F.size("_listed"))).first()[0] or 1
    ladder = listed.select("model", F.transform("_listed", lambda t: t["threshold"]).alias("_ladder"))
    met = scores.select("model", "mae", degraded.alias("degraded")).join(ladder, "model")
    ranked = with_rank(met, "_ladder", F.col("mae"), "rank", longest).select("model", "rank", "degraded")
    counted = ranked.groupBy("model", "rank").agg(
        count_where(F.col("degraded")).alias("pos"), count_where(~F.col("degraded")).alias("neg")
    )
    # Flagged at the i-th threshold (from 0): samples whose rank exceeds i.
    steps = listed.select("model", F.posexplode("_listed").alias("i", "t")).select(
        "model",
        (F.col("i") + 1).alias("rank"),
        F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("neg"),
        F.col("t.pct").alias("pct"),
        F.col("t.threshold").alias("threshold"),
    )
    nothing = [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in ("pct", "threshold")]
    events = steps.unionByName(counted.select("model", "rank", "pos", "neg", *nothing))
    down = (
        Window.partitionBy("model")
        .orderBy(F.desc("rank"), F.asc_nulls_first("pct"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = Window.partitionBy("model")
    totals = events.select(
        "model",
        "pct",
        "threshold",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("p"),
        F.sum("neg").over(whole).alias("n"),
    ).where(F.col("pct").isNotNull())
    return totals.select(
        "model",
        "pct",
        "threshold",
        "tp",
        "fp",
        (F.col("n") - F.col("fp")).alias("tn"),
        (F.col("p") - F.col("tp")).alias("fn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F and false-positive rate; null where a denominator is zero."""
    with_rates = counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        }
    )
    return with_rates.withColumn("f", f_score(F.col("precision"), F.col("recall")))


def negative_rates(counts: DataFrame) -> DataFrame:
    """The same three figures for the healthy class."""
    with_rates = counts.withColumns(
        {
            "neg_precision": ratio(F.col("tn"), F.col("tn") + F.col("fn")),
            "neg_recall": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
        }
    )
    return with_rates.withColumn("neg_f", f_score(F.col("neg_precision"), F.col("neg_recall")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Per model, the row of highest F; the lowest percentile wins a tie."""
    better = Window.partitionBy("model").orderBy(F.desc_nulls_last("f"), "pct")
    return sweep.withColumn("_rank", F.row_number().over(better)).where(F.col("_rank") == 1).drop("_rank")


def evaluation_table(sweep: DataFrame) -> DataFrame:
    return sweep.select(
        "model", "pct", *[F.round(c, 3).alias(c) for c in ("threshold", "precision", "recall")]
    )


def population_draw(seed: int = POPULATION_SEED, key: str = "sample_id") -> Column:
    return uniform(F.col(key), seed=seed)


def _population_level(cuts: Sequence[tuple[float, int]]):
    def level(u: Column) -> Column:
        choice = F.lit(100)
        for bound, soc in reversed(list(cuts)):
            choice = F.when(u >= bound, F.lit(soc)).otherwise(choice)
        return choice

    return level


def mixed_population(
    scores: DataFrame,
    cuts: Sequence[tuple[float, int]] = tuple(SWEEP_POPULATION),
    draw: Column | None = None,
) -> DataFrame:
    """One health level per sample, picked by a draw. All levels are rows of one table, so picking is a filter."""
    draw = population_draw() if draw is None else draw
    return scores.where(F.col("soc") == bind(draw, _population_level(cuts)))


def stream_population(
    scores: DataFrame, cuts: Sequence[tuple[float, int]] = tuple(SWEEP_POPULATION), seed: int = POPULATION_SEED
) -> DataFrame:
    """``mixed_population`` with the draws of a sequential run: each model's samples, in the order of their ids, take the
    draws of the seeded generator from its first on.

    Both joins are merges: scores may be far more than the size of their file suggests, and that of a table of draws or
    picks grows with the samples, so neither must be sent to the driver whole.
    """
    spark = scores.sparkSession
    samples = numbered(scores.select("model", "sample_id").distinct(), "model", ["sample_id"], total="_n", index="draw")
    most = samples.agg(F.max("draw")).first()[0]
    drawn = samples.join(twister.draws(spark, 0 if most is None else most + 1, seed).hint("merge"), "draw")
    picked = drawn.select("model", "sample_id", bind(F.col("u"), _population_level(cuts)).alias("soc"))
    return scores.join(picked.hint("merge"), ["model", "sample_id", "soc"]).select(*scores.columns)


def flagged(population: DataFrame, threshold_rows: DataFrame) -> DataFrame:
    """0/1 columns tp, fp, tn, fn per sample at its model's threshold."""
    joined = population.join(small(threshold_rows.select("model", "threshold")), "model")
    hit, bad = F.col("mae") >= F.col("threshold"), is_degraded()
    return joined.withColumns(
        {
            "tp": (hit & bad).cast("int"),
            "fp": (hit & ~bad).cast("int"),
            "tn": (~hit & ~bad).cast("int"),
            "fn": (~hit & bad).cast("int"),
        }
    ).drop("threshold")


def flag_totals(flags: DataFrame) -> DataFrame:
    return flags.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def precision_at(flags: DataFrame, k: int = INTERVENTIONS) -> DataFrame:
    """True positives among each model's ``k`` largest errors, divided by ``k`` even when there are fewer."""
    worst = Window.partitionBy("model").orderBy(F.desc("mae"), "sample_id")
    top = flags.withColumn("_rank", F.row_number().over(worst)).where(F.col("_rank") <= k)
    return top.groupBy("model").agg((F.sum("tp") / k).alias("precision_at_k"))


def running_curve(
    flags: DataFrame,
    positive: bool = True,
    hot: DataFrame | str | None = MEASURE,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Precision and recall after each predicted-positive sample by falling error (or predicted-negative by rising)."""
    right, wrong, missed = ("tp", "fp", "fn") if positive else ("tn", "fn", "fp")
    relevant = small(flags.groupBy("model").agg((F.sum(right) + F.sum(missed)).alias("relevant")))
    chosen = flags.where((F.col(right) == 1) | (F.col(wrong) == 1))
    hot = measured(chosen, ["model"], hot, max_rows)
    sums = {"hits": F.col(right), "misses": F.col(wrong)}
    curve = running(chosen, ["model"], "mae", ["sample_id"], sums, hot, descending=positive)
    return curve.join(relevant, "model").select(
        "model",
        "sample_id",
        "mae",
        ratio(F.col("hits"), F.col("relevant")).alias("rcl"),
        ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("prc"),
    )


def mean_precision(positive_curve: DataFrame, negative_curve: DataFrame) -> DataFrame:
    """Mean of the precision column over each curve, and the mean of both."""
    pos = positive_curve.groupBy("model").agg(F.avg("prc").alias("pos_ap"))
    neg = negative_curve.groupBy("model").agg(F.avg("prc").alias("neg_ap"))
    both = pos.join(neg, "model", "full_outer")
    return both.withColumn("map", (F.col("pos_ap") + F.col("neg_ap")) / 2)


def roc_points(sweep: DataFrame) -> DataFrame:
    """Points in threshold order with their ordinal, which counts from 10."""
    order = Window.partitionBy("model").orderBy("pct")
    return sweep.select("model", "pct", "fpr", "recall", (F.row_number().over(order) + 9).alias("ordinal"))


def area_under(points: DataFrame) -> DataFrame:
    """Trapezoid area along the points; their order may rise or fall."""
    order = Window.partitionBy("model").orderBy("ordinal")
    step = F.col("fpr") - F.lag("fpr").over(order)
    height = (F.col("recall") + F.lag("recall").over(order)) / 2
    return (
        points.withColumn("_area", step * height)
        .groupBy("model")
        .agg(F.abs(F.sum("_area")).alias("auroc"))
    )


def map_report(
    scores: DataFrame, percent: int, draw: Column | None = None, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Flags, both curves and the one-row-per-model report of a mixed population at one threshold.

    The scores are measured once; the bounds serve the threshold and both curves. Flags are staged, as five branches
    read them.
    """
    hot = find_hot(scores, ["model"], max_rows)
    limit = percentile_threshold(scores, percent, hot)
    flags = stage(flagged(mixed_population(scores, MAP_POPULATION, draw), limit))
    positive, negative = running_curve(flags, True, hot), running_curve(flags, False, hot)
    totals = negative_rates(rates(flag_totals(flags)))
    report = totals.join(mean_precision(positive, negative), "model").join(precision_at(flags), "model")
    return flags, positive, negative, report
