"""Whitening of embeddings: scatter and projection as products of distributed block matrices.

Entries become whole numbers first, ``floor(64 * entry) + 1000000``, so that sums, counts and deviations are exact. The
scatter is taken over the *fit list*, each distinct vector once, so that copies don't weigh. Centred rows are indexed into
MLlib block matrices; the transposed matrix times itself gives the scatter, whose eigenvectors are found on the driver
(width x width numbers, whatever the number of rows), and the rows' matrix times the whitening matrix projects them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampwise.llm.numbering import indexed

# The Python functions of this module travel with their tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 2048
BLOCK_COLUMNS = 1024
BLOCKS_A_SPLIT = 8  # row blocks whose products one task adds up
LARGEST = float(1 << 40)  # entries beyond are outside the whole numbers that are kept exact
NULL_VARIANCE = 1e-12  # of the trace; a direction below has no variance to divide by


@dataclass(frozen=True)
class Whitening:
    """Size and sums of the fit list, variances by falling size with their components as columns, and what is left.

    ``weights`` whiten a centred row; ``identity_error`` is the largest absolute entry of the covariance of the whitened
    fit list less the identity.
    """

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


def whole_numbers(column: str = "embedding") -> Column:
    """The vector in whole numbers; null if it is null, empty, or has an entry that is null, not finite or beyond 2**34."""
    entries = F.transform(column, lambda c: c.cast("double") * SCALE)
    held = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    sound = F.when(held & (F.size(column) > 0), entries)
    return F.transform(sound, lambda c: F.floor(c).cast("long") + SHIFT)


def _commonest_width(rows: DataFrame) -> int | None:
    """The width that most rows have, the greater one if two tie; None without rows."""
    found = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found["width"] if found else None


def _block_matrix(rows: DataFrame, vector: Column, width: int) -> BlockMatrix:
    """Rows with an ``index`` and a vector as blocks; all of it inside the JVM."""
    vectors = rows.select("index", array_to_vector(vector).alias("vector"))
    table = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(table, 0, width).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def _scatter(matrix: BlockMatrix, rows: int) -> np.ndarray:
    """The transposed matrix times itself.

    A product of two tall matrices has few blocks, each the sum over all row blocks. MLlib adds them up in
    ``numMidDimSplits`` tasks first and those sums then; Python's ``multiply`` leaves that argument out and would bring
    every row to one task, so the method is called with it.
    """
    splits = max(1, -(-rows // (BLOCK_ROWS * BLOCKS_A_SPLIT)))
    model = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", model._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _projected(matrix: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """Every row times the weights, a small matrix that each block meets."""
    width, kept = weights.shape
    parts = [
        ((first // BLOCK_COLUMNS, 0), Matrices.dense(len(part), kept, part.ravel(order="F")))
        for first in range(0, width, BLOCK_COLUMNS)
        for part in [weights[first : first + BLOCK_COLUMNS]]
    ]
    blocks = matrix.blocks.context.parallelize(parts, 1)
    return matrix.multiply(BlockMatrix(blocks, BLOCK_COLUMNS, kept, width, kept))


def centred(n: int, sums: list[int]) -> Column:
    """``x`` less the mean, as doubles: the whole part of the mean goes first, so nothing is rounded before."""
    base = [s // n for s in sums]
    rest = [(s - b * n) / n for s, b in zip(sums, base)]
    whole = F.zip_with("x", F.lit(base).cast("array<bigint>"), lambda v, b: (v - b).cast("double"))
    return F.zip_with(whole, F.lit(rest).cast("array<double>"), lambda v, r: v - r)


def deviation(n: int, sums: list[int]) -> Column:
    """The sum over dimensions of ``(n * x - S)**2``, exact; null where it is beyond a long."""
    count, whole = F.lit(n).cast("decimal(19,0)"), F.lit([str(v) for v in sums]).cast("array<decimal(38,0)>")
    gaps = F.zip_with("x", whole, lambda v, s: (v.cast("decimal(19,0)") * count - s).try_cast("decimal(19,0)"))
    nothing = F.lit(0).cast("decimal(38,0)")
    squares = F.aggregate(gaps, nothing, lambda total, g: F.try_add(total, F.try_multiply(g, g)).try_cast("decimal(38,0)"))
    return squares.try_cast("bigint")


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of indexed distinct vectors ``(index, x)``."""
    sums = [F.sum(F.col("x")[k].cast("decimal(38,0)")) for k in range(width)]
    n, *totals = distinct.select(F.count(F.lit(1)), *sums).first()
    totals = [int(v) for v in totals]
    matrix = _block_matrix(distinct, centred(n, totals), width)
    covariance = _scatter(matrix, n) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > NULL_VARIANCE * trace]
    leading = vectors[:, order]
    # The sign follows the largest entry, so that a refit agrees.
    leading = leading * np.sign(leading[np.abs(leading).argmax(axis=0), np.arange(len(order))])
    found = Whitening(n, totals, values[order], leading, trace)
    if not len(order):
        return found
    whitened = _scatter(_projected(matrix, found.weights), n) / n
    return replace(found, identity_error=float(np.abs(whitened - np.eye(len(order))).max()))


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each row's coordinates along the leading components of the fit list's covariance, in units of their spread.

    Returns ``<key>, component, n, deviation, whitened, explained, identity_error``, components from 1. Vectors that are
    null, empty, hold a null or non-finite entry, an entry of 2**34 or more, or have another width than most rows are left
    out. Repeated rows and null keys stay rows of their own. Components without variance (fewer distinct vectors than
    dimensions, constant dimensions) are not returned, so equal vectors alone give no row, as does an empty table. Other
    columns don't matter, whatever their names.
    """
    spark = rows.sparkSession
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sound = rows.select(F.col(key).alias("key"), whole_numbers(column).alias("x")).where(F.col("x").isNotNull())
    held = indexed(sound)
    width = _commonest_width(held)
    if width is None:
        return spark.createDataFrame([], schema)
    held = held.where(F.size("x") == width)
    found = fit(indexed(held.select("x").distinct()), width, components)
    if not len(found.variances):
        return spark.createDataFrame([], schema)
    projected = _projected(_block_matrix(held, centred(found.n, found.sums), width), found.weights).toIndexedRowMatrix()
    whitened = projected.rows.map(lambda row: (int(row.index), row.vector.toArray().tolist()))
    whitened = spark.createDataFrame(whitened, "index bigint, whitened array<double>")
    measured = held.select("index", "key", deviation(found.n, found.sums).alias("deviation")).join(whitened, "index")
    shares = F.lit([float(v / found.trace) for v in found.variances]).cast("array<double>")
    entries = measured.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return entries.select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
