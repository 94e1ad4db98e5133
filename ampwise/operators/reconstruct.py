"""Linear reconstruction of samples: fit on healthy data, score by mean absolute error.

A model is the mean and the leading principal components of its training samples. The components follow from sums
and cross-products, which add up over folds: one pass over the samples yields the moments of every fold, and every
leave-one-fold-out model is a combination of them. Moments are taken about the mean of all samples, found in a pass
before, so that a large mean does not cancel a small variance.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Python functions of this module travel with their tasks, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODE_SIZE = 13
SEARCH_SIZES = tuple(range(7, 20))


@dataclass(frozen=True)
class LinearModel:
    name: str
    mean: np.ndarray
    components: np.ndarray  # width x code size, columns by falling variance

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.mean + code @ self.components.T

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.decode(self.encode(x))


def centre_of(samples: DataFrame, column: str = "x") -> np.ndarray | None:
    """Mean of each entry over all samples, as many numbers as a sample has; None without a sample."""
    entries = samples.select(F.posexplode(column).alias("entry", "value"))
    rows = entries.groupBy("entry").agg(F.avg("value").alias("mean")).orderBy("entry").collect()
    return np.array([r["mean"] for r in rows], dtype=float) if rows else None


def moments(samples: DataFrame, group: str, column: str = "x", centre: np.ndarray | None = None) -> DataFrame:
    """Per group and entry, the sum of ``[1, x] outer [1, x]``: count, sums and cross-products in one matrix.

    With ``centre``, of the samples less the centre.

    Each task adds up its own samples batch by batch and emits one matrix per group it saw; Spark adds the matrices.
    """
    group_type = samples.schema[group].dataType

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby("g"):
                x = np.stack(part["x"].to_numpy()).astype(float) - (0.0 if centre is None else centre)
                one = np.hstack([np.ones((len(x), 1)), x])
                sums[key] = sums.get(key, 0.0) + one.T @ one
        if sums:
            yield pd.DataFrame({"g": list(sums), "m": [m.ravel() for m in sums.values()]})

    schema = T.StructType([T.StructField("g", group_type), T.StructField("m", T.ArrayType(T.DoubleType()))])
    parts = samples.select(F.col(group).alias("g"), F.col(column).alias("x")).mapInPandas(partial, schema)
    return (
        parts.select(F.col("g").alias(group), F.posexplode("m").alias("entry", "value"))
        .groupBy(group, "entry")
        .agg(F.sum("value").alias("value"))
    )


def collect_moments(moment_table: DataFrame, group: str) -> dict[object, np.ndarray]:
    """Moments on the driver: groups x (width + 1)^2 numbers, independent of the number of samples."""
    table = moment_table.toPandas()
    out = {}
    for key, part in table.groupby(group):
        flat = part.sort_values("entry")["value"].to_numpy()
        width = int(round(len(flat) ** 0.5))
        out[key] = flat.reshape(width, width)
    return out


def model_from_moments(
    name: str, parts: Iterable[np.ndarray], size: int, centre: np.ndarray | float = 0.0
) -> LinearModel:
    """The model of the summed ``parts``; ``centre`` is what its samples were taken less of."""
    total = sum(parts)
    n = total[0, 0]
    mean = total[0, 1:] / n
    covariance = total[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(covariance)
    leading = vectors[:, np.argsort(values)[::-1][:size]]
    # Fix each component's sign by its largest entry, so that refits agree.
    signs = np.sign(leading[np.abs(leading).argmax(axis=0), np.arange(leading.shape[1])])
    return LinearModel(name, centre + mean, leading * np.where(signs == 0, 1, signs))


def fit_splits(
    samples: DataFrame, learn_folds: Sequence[int], size: int = CODE_SIZE, name: str = "K_{}"
) -> dict[int, LinearModel]:
    """One model per left-out fold, all from a single pass. Models are named from 1 in fold order."""
    learned = samples.where(F.col("fold").isin(list(learn_folds)))
    centre = centre_of(learned)
    by_fold = collect_moments(moments(learned, "fold", centre=centre), "fold")
    return {
        fold: model_from_moments(
            name.format(i + 1), [m for f, m in by_fold.items() if f != fold], size, centre
        )
        for i, fold in enumerate(learn_folds)
        if any(f != fold for f in by_fold)
    }


def fit_one(samples: DataFrame, size: int, name: str = "model") -> LinearModel:
    whole = samples.withColumn("_one", F.lit(0))
    centre = centre_of(samples)
    if centre is None:
        raise ValueError("no sample to fit")
    return model_from_moments(name, collect_moments(moments(whole, "_one", centre=centre), "_one").values(), size, centre)


def _rows(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def _by_model(models: dict[str, LinearModel], names: pd.Series, x: np.ndarray, apply, width: int = 0) -> np.ndarray:
    """``apply`` of each row's model: numbers, or rows of at most ``width`` numbers padded with NaN."""
    out = np.full((len(x), width) if width else len(x), np.nan)
    labels = names.to_numpy()
    for name in pd.unique(names):
        at = np.flatnonzero(labels == name)
        found = apply(models[name], x[at])
        if width:
            out[at, : found.shape[1]] = found
        else:
            out[at] = found
    return out


def _named(models: Iterable[LinearModel]) -> dict[str, LinearModel]:
    return {m.name: m for m in models}


def reconstruct(samples: DataFrame, models: Iterable[LinearModel], model: str = "model") -> DataFrame:
    """Add ``x_hat`` and ``code`` under the model each sample names."""
    named = _named(models)

    @F.pandas_udf("struct<x_hat:array<double>,code:array<double>>")
    def both(names: pd.Series, x: pd.Series) -> pd.DataFrame:
        values = _rows(x)
        longest = max(m.components.shape[1] for m in named.values())
        codes = _by_model(named, names, values, lambda m, v: m.encode(v), longest)
        hats = np.empty_like(values)
        used = names.map(lambda n: named[n].components.shape[1]).to_numpy()
        for name in pd.unique(names):
            at = np.flatnonzero(names.to_numpy() == name)
            hats[at] = named[name].decode(codes[at, : named[name].components.shape[1]])
        return pd.DataFrame({"x_hat": list(hats), "code": [c[:n] for c, n in zip(codes, used)]})

    return samples.withColumn("_r", both(model, "x")).select("*", "_r.*").drop("_r")


def score(samples: DataFrame, models: Iterable[LinearModel], model: str = "model") -> DataFrame:
    """Replace ``x`` by the sample's mean absolute reconstruction error under the model it names."""
    named = _named(models)

    @F.pandas_udf("double")
    def error(names: pd.Series, x: pd.Series) -> pd.Series:
        values = _rows(x)
        gaps = _by_model(named, names, values, lambda m, v: np.abs(v - m.reconstruct(v)).mean(axis=1))
        return pd.Series(gaps, dtype=float)

    return samples.withColumn("mae", error(model, "x")).drop("x")


def validation_scores(samples: DataFrame, models: dict[int, LinearModel]) -> DataFrame:
    """Each learning sample scored by the model that left its fold out."""
    named = F.create_map(*[F.lit(v) for fold, m in models.items() for v in (fold, m.name)])
    held = samples.where(F.col("fold").isin(list(models)))
    return score(held.withColumn("model", named[F.col("fold")]), models.values())


def project(samples: DataFrame, model: LinearModel, axes: int = 2) -> DataFrame:
    """The leading coordinates of each sample's code, for inspection."""
    coded = reconstruct(samples.withColumn("model", F.lit(model.name)), [model])
    return coded.select(*[c for c in samples.columns if c != "x"], *[
        F.col("code")[i].alias(f"axis_{i + 1}") for i in range(axes)
    ])


def size_errors(samples: DataFrame, model: LinearModel, sizes: Sequence[int]) -> DataFrame:
    """Errors of the nested models of several code sizes: ``(keys, size, mae, huber)`` in one scan.

    ``model`` must hold at least ``max(sizes)`` components; a greater size is an error.
    """
    sizes = list(sizes)
    if max(sizes, default=0) > model.components.shape[1]:
        raise ValueError(f"code size {max(sizes)} is above the {model.components.shape[1]} components of the model")

    @F.pandas_udf("struct<mae:array<double>,huber:array<double>>")
    def errors(x: pd.Series) -> pd.DataFrame:
        values = _rows(x)
        code = model.encode(values)
        mae, huber = np.empty((len(values), len(sizes))), np.empty((len(values), len(sizes)))
        for i, size in enumerate(sizes):
            gap = np.abs(values - model.mean - code[:, :size] @ model.components[:, :size].T)
            mae[:, i] = gap.mean(axis=1)
            huber[:, i] = np.where(gap < 1, 0.5 * gap**2, gap - 0.5).mean(axis=1)
        return pd.DataFrame({"mae": list(mae), "huber": list(huber)})

    kept = [c for c in samples.columns if c != "x"]
    sized = samples.select(*kept, errors("x").alias("_e"))
    zipped = F.arrays_zip(F.lit(sizes).cast("array<int>").alias("size"), F.col("_e.mae").alias("mae"), F.col("_e.huber").alias("huber"))
    return sized.select(*kept, F.inline(zipped))


def models_table(spark: SparkSession, models: Iterable[LinearModel]) -> DataFrame:
    """Models as rows, for storing next to their scores."""
    rows = [(m.name, m.mean.tolist(), m.components.T.tolist()) for m in models]
    return spark.createDataFrame(rows, "model string, mean array<double>, components array<array<double>>")


def models_from_table(table: DataFrame) -> list[LinearModel]:
    return [LinearModel(r.model, np.array(r.mean), np.array(r.components).T) for r in table.collect()]


def sample_key(*columns: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
