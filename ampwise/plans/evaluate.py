"""From synthetic blows to scored health levels: fit on healthy folds, pick the best model, score every level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.functions.labels import capacity_label
from ampwise.operators import folds, metrics, reconstruct, scaling, steps
from ampwise.schema import EPISODE
from ampwise.session import small, stage
from ampwise.sources import stores

FOLDS = 6
SAMPLE_KEYS = ["soc", *EPISODE]


@dataclass(frozen=True)
class Evaluation:
    models: list[reconstruct.LinearModel]
    validation: DataFrame
    best: DataFrame
    thresholds: DataFrame
    scores: DataFrame


def prepare(blows: DataFrame, fit_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scaled sample arrays and the bounds used, of blows as rows or with their ``steps``.

    Bounds come from all healthy blows, the test fold included, as evaluation defines it; pass ``fit_on`` to fit on
    training blows only.
    """
    if "steps" not in blows.columns:
        blows = stage(steps.gather(blows))
    if fit_on is None:
        bounds = steps.fit_bounds(blows.where(F.col("soc") == 100))
    else:
        bounds = steps.fit_bounds(fit_on) if "steps" in fit_on.columns else scaling.fit_bounds(fit_on)
    return steps.sample_arrays(blows, bounds), bounds


def _truncated(samples: DataFrame, groups: list[str], batch: int | None) -> DataFrame:
    return samples if batch is None else scaling.batch_compatible(samples, EPISODE, batch, groups)


def run(
    blows: DataFrame,
    fold_map: DataFrame,
    size: int = reconstruct.CODE_SIZE,
    batch: int | None = None,
    k: int = FOLDS,
) -> Evaluation:
    """Train k-1 models on the learning folds, keep the one of lowest validation error, score the test fold.

    Folds are computed once, at full health, and reused for every level. All samples are scored; with ``batch``, sets
    are first cut to whole batches, as a model of fixed batch size needs. No sample to validate or to test is an error.
    """
    prepared, _ = prepare(blows)
    samples = stage(folds.assign_folds(prepared, fold_map))
    healthy = samples.where(F.col("soc") == 100)
    learn = list(range(k - 1))
    models = reconstruct.fit_splits(healthy, learn, size)
    held = _truncated(healthy.where(F.col("fold") < k - 1), ["fold"], batch)
    validation = stage(reconstruct.validation_scores(held, models))
    if validation.isEmpty():
        raise ValueError("no sample to validate: too few episodes, or folds smaller than a batch")
    best = small(metrics.best_model(validation))
    chosen = validation.join(best.select("model"), "model")
    thresholds = metrics.thresholds(chosen)
    test = _truncated(
        samples.where((F.col("fold") == k - 1) & F.col("soc").isin(metrics.HEALTH_LEVELS)), ["soc"], batch
    )
    named = test.join(best.select("model"))
    scored = reconstruct.score(named, models.values())
    scores = stage(scored.select("model", "soc", reconstruct.sample_key(*EPISODE).alias("sample_id"), "mae"))
    if scores.isEmpty():
        raise ValueError("no sample to test: too few episodes, or levels smaller than a batch")
    return Evaluation(list(models.values()), validation, best, thresholds, scores)


def save(result: Evaluation, path: str) -> None:
    """Store an evaluation, so that reports need neither the samples nor a new fit."""
    spark = result.scores.sparkSession
    stores.save_evaluation(path, result.scores, result.thresholds, reconstruct.models_table(spark, result.models))


def stored_report(
    spark: SparkSession, path: str, percent: int = metrics.BOX_PERCENT, model: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Boxes of stored scores per model and level, labelled by capacity, and the rates at one stored threshold."""
    scores, limits = stores.load_evaluation(spark, path, model)
    position = ((100 - F.col("soc")) / 5).cast("int")
    boxes = metrics.box_stats(scores, ["model", "soc"], "mae").withColumn("capacity", capacity_label(position))
    return boxes, metrics.rates(metrics.confusion(scores, limits.where(F.col("pct") == percent)))


def size_search(
    blows: DataFrame, fold_map: DataFrame, sizes=reconstruct.SEARCH_SIZES, batch: int | None = None
) -> DataFrame:
    """Validation errors by code size: the models are nested, so one basis and one scan serve every size."""
    prepared, _ = prepare(blows.where(F.col("soc") == 100))
    samples = stage(folds.assign_folds(prepared, fold_map).withColumn("role", folds.search_role(F.col("fold"))))
    basis = reconstruct.fit_one(samples.where(F.col("role") == "train"), max(sizes))
    held = _truncated(samples.where(F.col("role") == "valid"), [], batch)
    errors = stage(reconstruct.size_errors(held, basis, sizes))
    if errors.isEmpty():
        raise ValueError("no sample to validate: too few episodes, or fewer than a batch")
    tail = metrics.named_percentiles(errors, ["size"], "mae", {"p90_mae": 0.9})
    means = errors.groupBy("size").agg(F.avg("mae").alias("mean_mae"), F.avg("huber").alias("mean_huber"))
    return means.join(tail, "size").withColumn("score", F.col("mean_mae") + F.col("p90_mae"))
