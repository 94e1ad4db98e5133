"""One reconstruction model per group of wide samples, fitted and applied without the driver.

For folds, a handful, ``reconstruct`` adds up moments and solves on the driver. Here groups may be many and samples wide, so
moments stay in tables, one row per group and matrix row; a group's model comes from all samples less its own, solved in a
task; models are rows, and samples meet their model in the task that scores them. A task holds one matrix at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampwise.operators.reconstruct import centre_of
from ampwise.session import small, stage

# The Python functions of this module travel with their tasks, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARE_ROWS = 65_536  # of one group in one task
HELD_BYTES = 64 << 20  # of matrices that a task holds before it passes them on


def _stacked(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """First and after-last place of each run of equal keys."""
    first = 0
    while first < len(keys):
        after = first + 1
        while after < len(keys) and keys[after] == keys[first]:
            after += 1
        yield first, after
        first = after


def _matrix_rows(key, matrix: np.ndarray, key_type: pa.DataType) -> pa.RecordBatch:
    size = len(matrix)
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * size, key_type), pa.array(range(size), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))],
        names=["g", "i", "row"],
    )


def _moments(centre: np.ndarray):
    """Sums of ``[1, x] outer [1, x]`` of the groups in a task, passed on when the held matrices grow too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key_type = {}, None
        most = max(1, HELD_BYTES // (8 * (len(centre) + 1) ** 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column("g").to_pylist(), _stacked(batch.column("x")) - centre
            key_type = batch.schema.field("g").type
            one = np.hstack([np.ones((len(x), 1)), x])
            order = sorted(range(len(keys)), key=lambda k: (keys[k] is not None, keys[k]))
            keys, one = [keys[k] for k in order], one[order]
            for first, after in _runs(keys):
                if keys[first] not in held and len(held) >= most:
                    for key, matrix in held.items():
                        yield _matrix_rows(key, matrix, key_type)
                    held = {}
                part = one[first:after]
                held[keys[first]] = held.get(keys[first], 0.0) + part.T @ part
        for key, matrix in held.items():
            yield _matrix_rows(key, matrix, key_type)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of consecutive rows of equal (g, i)."""
    key, total, schema = None, None, None
    for batch in batches:
        schema = batch.schema
        if not batch.num_rows:
            continue
        keys, rows = list(zip(batch.column("g").to_pylist(), batch.column("i").to_pylist())), _stacked(batch.column("row"))
        out = []
        for first, after in _runs(keys):
            part = rows[first:after].sum(axis=0)
            if keys[first] == key:
                total = total + part
                continue
            if key is not None:
                out.append((key, total))
            key, total = keys[first], part
        if out:
            yield _summed(out, schema)
    if key is not None:
        yield _summed([(key, total)], schema)


def _summed(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [v for _, v in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _solve(size: int, centre: np.ndarray):
    """A model per run of matrix rows ``(g, i, row)``, as ``reconstruct.model_from_moments`` has it."""

    def model(key, rows: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch | None:
        total = np.stack(rows)
        n = total[0, 0]
        if n < 0.5:
            return None
        mean = total[0, 1:] / n
        covariance = total[1:, 1:] / n - np.outer(mean, mean)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:size]
        leading = vectors[:, order]
        signs = np.sign(leading[np.abs(leading).argmax(axis=0), np.arange(leading.shape[1])])
        leading = leading * np.where(signs == 0, 1, signs)
        residual = float(np.abs(covariance @ leading - leading * values[order]).max())
        numbers = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key], key_type),
                pa.array([int(round(n))], pa.int64()),
                pa.array([centre + mean], numbers),
                pa.array([list(leading.T)], pa.list_(numbers)),
                pa.array([values[order]], numbers),
                pa.array([float(np.trace(covariance))], pa.float64()),
                pa.array([residual], pa.float64()),
            ],
            names=["g", "n", "mean", "components", "variances", "trace", "residual"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, key_type = None, [], None
        for batch in batches:
            key_type = batch.schema.field("g").type
            for g, i, row in zip(batch.column("g").to_pylist(), batch.column("i").to_pylist(), _stacked(batch.column("row")) if batch.num_rows else []):
                if i == 0 and rows:
                    if (found := model(key, rows, key_type)) is not None:
                        yield found
                    rows = []
                key = g
                rows.append(row)
        if rows and (found := model(key, rows, key_type)) is not None:
            yield found

    return run


def fit_left_out(samples: DataFrame, group: str, size: int, column: str = "x") -> DataFrame:
    """For each group the model of all samples outside it: ``group, n, mean, components, variances, trace, residual``.

    The residual is the largest entry by which a component fails to be an eigenvector of the covariance.
    Samples are dealt by shares of their groups, so that a task meets few groups one after the other. Matrices move row by
    row. A group that holds every sample has no model, nor has an empty table. Groups must not be null.
    """
    centre = centre_of(samples, column)
    key = samples.schema[group].dataType
    model = T.StructType.fromDDL("n bigint, mean array<double>, components array<array<double>>, variances array<double>, trace double, residual double")
    fitted = T.StructType([T.StructField("g", key), *model])
    if centre is None:
        return samples.sparkSession.createDataFrame([], fitted).withColumnRenamed("g", group)
    rows = T.StructType.fromDDL("i int, row array<double>")
    matrix = T.StructType([T.StructField("g", key), *rows])
    named = samples.select(F.col(group).alias("g"), F.col(column).alias("x"))
    dealt = named.join(small(_shares(named, "g")), "g").withColumn("share", _share("x"))
    dealt = dealt.repartition("g", "share").sortWithinPartitions("g", "share").select("g", "x")
    parts = dealt.mapInArrow(_moments(centre), matrix)
    own = stage(parts.repartition("g", "i").sortWithinPartitions("g", "i").mapInArrow(_add_up, matrix))
    every = own.select(F.lit(0).alias("g"), "i", "row").repartition("i").sortWithinPartitions("i")
    total = every.mapInArrow(_add_up, "g int, i int, row array<double>").select("i", F.col("row").alias("all"))
    rest = own.join(total, "i").select("g", "i", F.zip_with("all", "row", lambda a, b: a - b).alias("row"))
    solved = rest.repartition("g").sortWithinPartitions("g", "i").mapInArrow(_solve(size, centre), fitted)
    return solved.withColumnRenamed("g", group)


def _shares(samples: DataFrame, group: str) -> DataFrame:
    """Into how many shares each group's samples are dealt."""
    counted = samples.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(group, F.ceil(F.col("rows") / SHARE_ROWS).alias("shares"))


def _share(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col("shares"))


def score_by(samples: DataFrame, models: DataFrame, group: str, column: str = "x") -> DataFrame:
    """Replace ``x`` by its mean absolute reconstruction error under the model of the sample's group.

    Samples and models are dealt alike by shares of the groups, the model before its samples, so a task holds one model.
    Samples of a group without a model are left out.
    """
    kept = [c for c in samples.columns if c != column]
    shares = small(_shares(samples, group))
    numbers = "array<double>"
    model = F.struct("mean", "components")
    none = F.lit(None)
    carried = F.struct(*kept)
    carried_type = samples.select(carried.alias("c")).schema["c"].dataType
    dealt = samples.join(shares, group).select(
        F.col(group).alias("g"), _share(column).alias("share"), F.lit(1).alias("kind"),
        none.cast("struct<mean:array<double>,components:array<array<double>>>").alias("model"),
        carried.alias("carried"), F.col(column).cast(numbers).alias("x"),
    )
    copies = models.join(shares, group).select(
        F.col(group).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"),
        model.alias("model"), none.cast(carried_type).alias("carried"), none.cast(numbers).alias("x"),
    )
    mixed = dealt.unionByName(copies).repartition("g", "share").sortWithinPartitions("g", "share", "kind")
    schema = T.StructType([T.StructField("carried", carried_type), T.StructField("mae", T.DoubleType())])
    return mixed.mapInArrow(_score_runs, schema).select("carried.*", "mae")


def _score_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, mean, axes = None, None, None
    for batch in batches:
        keys = list(zip(batch.column("g").to_pylist(), batch.column("share").to_pylist(), batch.column("kind").to_pylist()))
        for first, after in _runs(keys):
            if keys[first][2] == 0:
                model = batch.column("model")[after - 1].as_py()
                place, mean, axes = keys[first][:2], np.array(model["mean"]), np.array(model["components"])
            elif keys[first][:2] == place:
                part = batch.slice(first, after - first)
                gap = _stacked(part.column("x")) - mean
                error = np.abs(gap - (gap @ axes.T) @ axes).mean(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("carried"), pa.array(error)], names=["carried", "mae"])
