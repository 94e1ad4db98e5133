"""Sensor files: headerless gzip CSV, one file per thing."""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampwise.functions.labels import folder_stem
from ampwise.functions.signal import parse_timestamp
from ampwise.schema import CURRENT_FIELD, FILE_COLUMNS, MEASURES, RAW_SCHEMA, VOLTAGE_FIELD
from ampwise.session import small

log = logging.getLogger(__name__)

# Cell texts read as missing, not as bad numbers.
MISSING = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def read_raw(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines with their file, typed; unparsable lines keep their text in ``_bad``."""
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    lines = (
        spark.read.schema(schema)
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("columnPruning", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    named = lines.withColumnRenamed("THING", "name")
    return named.withColumn("thing", folder_stem(F.col("_metadata.file_name")))


def faulty(raw: DataFrame) -> Column:
    """Why a line rejects its file: ``fields`` for too many, ``cell`` for one that is neither a number nor missing; else null.

    Short lines are not a reason; their missing cells fall to the null drop. The test reads every measure, which also
    makes the CSV scan check every measure.
    """
    fields = F.split("_bad", ",")

    def unreadable(i: int) -> Column:
        text = F.trim(F.coalesce(F.get(fields, F.lit(i)), F.lit("")))
        return F.col(FILE_COLUMNS[i]).isNull() & ~text.isin(MISSING)

    cell = reduce(Column.__or__, [unreadable(i) for i in range(2, len(FILE_COLUMNS))])
    return F.when(F.size(fields) > len(FILE_COLUMNS), "fields").when(cell, "cell")


def rejected_things(raw: DataFrame) -> DataFrame:
    """Files to drop whole, with the reason of one of their lines."""
    named = raw.where(F.col("_bad").isNotNull()).select("thing", faulty(raw).alias("reason")).where(F.col("reason").isNotNull())
    return named.groupBy("thing").agg(F.min("reason").alias("reason"))


def clean(raw: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Accepted files only, timestamps parsed, rows with any null dropped, canonical columns added.

    Equal timestamps inside a thing are ordered by the row's content. The rejected things, found here unless given, are
    listed first and, while few, broadcast, so the rows need no shuffle by thing.
    """
    rejected = rejected_things(raw) if rejected is None else rejected
    kept = raw.join(small(rejected.select("thing")), "thing", "left_anti").drop("_bad")
    parsed = kept.withColumn("ts", parse_timestamp(F.col("TSTAMP"))).drop("TSTAMP")
    return parsed.dropna("any").select(
        "thing",
        "ts",
        F.xxhash64(*MEASURES).alias("seq"),
        F.col(CURRENT_FIELD).cast("double").alias("current"),
        F.col(VOLTAGE_FIELD).cast("double").alias("voltage"),
        "name",
        *[c for c in MEASURES if c not in (CURRENT_FIELD, VOLTAGE_FIELD)],
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, thing, size, modified`` of each file directly in ``folder``; contents are not read."""
    listed = spark.read.format("binaryFile").load(folder)
    thing = folder_stem(F.element_at(F.split("path", "/"), -1))
    return listed.select("path", thing.alias("thing"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def pending_paths(spark: SparkSession, folder: str, done: DataFrame | None, known: DataFrame | None = None) -> list[str]:
    """Files to open: those whose thing has no stored result, less files that were looked at before, as ``verdicts`` tell,
    and have not changed since.

    Paths are what the driver hands to any file scan anyway.
    """
    listed = files(spark, folder)
    if done is not None:
        listed = listed.join(done.select("thing").distinct(), "thing", "left_anti")
    if known is not None:
        listed = listed.join(known.select("thing", "size", "modified"), ["thing", "size", "modified"], "left_anti")
    return sorted(row.path for row in listed.select("path").collect())


def verdicts(raw: DataFrame, listed: DataFrame, rejected: DataFrame) -> DataFrame:
    """``thing, size, modified, lines, reason`` of the files that were read; the reason is null for accepted ones and
    ``empty`` where there is no line."""
    lines = raw.groupBy("thing").agg(F.count(F.lit(1)).alias("lines"))
    found = listed.select("thing", "size", "modified").join(lines, "thing", "left").join(rejected, "thing", "left")
    reason = F.when(F.col("lines").isNull(), "empty").otherwise(F.col("reason")).alias("reason")
    return found.select("thing", "size", "modified", F.coalesce("lines", F.lit(0)).alias("lines"), reason)


def is_folder(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        log.warning("%s is not a folder, nothing to do", folder)
        return False
    return True


def episode_store_path(root: str, suffix: str) -> str:
    return os.path.join(root, f"episodes_{suffix}")


def blow_store_path(root: str, suffix: str) -> str:
    return os.path.join(root, f"synthetic_{suffix}")


def file_store_path(root: str, suffix: str) -> str:
    return os.path.join(root, f"files_{suffix}")
