"""Stores that change in one step: tables under versions, and manifests that say which versions count.

A build writes its tables under a fresh version, where nobody reads them, and then a manifest: the keys (things, say) that
are stored, each with the version that holds its rows. A manifest is a folder of its own, and Spark's marker of a finished
write is what makes it count, so a build that is killed anywhere before leaves the store as it was. Readers take the
latest finished manifest and skip keys that a later version replaced. Nothing is overwritten; ``expire`` deletes what no
reader needs any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampwise.session import small

MANIFESTS, FINISHED = "manifests", "_SUCCESS"


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if there is no such folder."""
    system, where = _system(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(where)) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)


def _finished(spark: SparkSession, path: str) -> list[str]:
    found = [n for n in children(spark, f"{path}/{MANIFESTS}") if n.isdigit()]
    return [n for n in found if exists(spark, f"{path}/{MANIFESTS}/{n}/{FINISHED}")]


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries ``(keys, further columns, version, live)`` of the latest build; None for a store without one."""
    found = _finished(spark, path)
    return spark.read.parquet(f"{path}/{MANIFESTS}/{found[-1]}") if found else None


def entries(spark: SparkSession, path: str) -> DataFrame | None:
    """The keys that are stored, with their further columns."""
    current = manifest(spark, path)
    return None if current is None else current.where("live").drop("live", "version")


def _following(spark: SparkSession, path: str) -> int:
    """The number of the next manifest; that of one whose build was killed is not used again."""
    taken = [int(n) for n in children(spark, f"{path}/{MANIFESTS}") if n.isdigit()]
    return max(taken, default=0) + 1


def _commit(path: str, number: int, table: DataFrame) -> None:
    table.write.mode("errorifexists").parquet(f"{path}/{MANIFESTS}/{number:08d}")


def commit(
    path: str,
    keys: Sequence[str],
    stored: DataFrame | Callable[[dict[str, DataFrame]], DataFrame],
    tables: dict[str, tuple[DataFrame, Sequence[str]]],
) -> None:
    """Store ``tables``, name to (rows, columns to partition by), for the keys that ``stored`` lists.

    ``stored`` may be a function of the tables as they were written, so that they need not be computed again for it.

    What was stored for these keys is replaced, keys without rows included; other keys stay. A build must be the only one
    of its store: one that finds, at its end, a manifest that was not there when it began fails.
    """
    of_written = None if isinstance(stored, DataFrame) else stored
    spark = stored.sparkSession if of_written is None else next(iter(tables.values()))[0].sparkSession
    keys, written = list(keys), {}
    number = _following(spark, path)  # taken before the manifest is read
    before = manifest(spark, path)
    version = f"v{uuid.uuid4().hex}"
    for name, (rows, parts) in tables.items():
        writer = rows.write.mode("errorifexists")
        folder = f"{path}/{name}/version={version}"
        (writer.partitionBy(*parts) if parts else writer).parquet(folder)
        written[name] = spark.read.schema(rows.schema).parquet(folder)
    stored = stored if of_written is None else of_written(written)
    fresh = stored.distinct().withColumns({"version": F.lit(version), "live": F.lit(True)})
    if before is not None:
        replaced = before.join(fresh.select(*keys, F.lit(False).alias("_kept")), keys, "left")
        kept = replaced.withColumn("live", F.col("live") & F.coalesce("_kept", F.lit(True))).drop("_kept")
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
    _commit(path, number, fresh)


def read(spark: SparkSession, path: str, name: str, text_keys: Sequence[str] = ()) -> DataFrame | None:
    """The rows of a table as of the latest build; None if no build has any.

    ``text_keys`` are read as text: a thing named 007 must not become a number. Only versions in use are listed, and
    only replaced keys, few as a rule, are filtered out, so rows need no shuffle.
    """
    current = manifest(spark, path)
    if current is None:
        return None
    keys = [c for c in current.columns if c not in ("version", "live")]
    versions = [r.version for r in current.where("live").select("version").distinct().collect()]
    folders = [f"{path}/{name}/version={v}" for v in sorted(versions)]
    folders = [f for f in folders if any(not n.startswith(("_", ".")) for n in children(spark, f))]
    if not folders:
        return None
    based = spark.read.option("basePath", f"{path}/{name}")
    fields = [T.StructField(f.name, T.StringType()) if f.name in (*text_keys, "version") else f for f in based.parquet(*folders).schema]
    rows = based.schema(T.StructType(fields)).parquet(*folders)
    shared = [c for c in keys if c in rows.columns]
    stale = current.where(~F.col("live") & F.col("version").isin(versions)).select(*shared, "version")
    return rows.join(small(stale), [*shared, "version"], "left_anti").drop("version")


def expire(spark: SparkSession, path: str) -> list[str]:
    """Delete versions that hold nothing live, and all but the latest manifest; return the versions. For when nobody reads
    an earlier build or writes a new one."""
    current = manifest(spark, path)
    if current is None:
        return []
    live = {r.version for r in current.where("live").select("version").distinct().collect()}
    gone = set()
    for table in children(spark, path):
        if table == MANIFESTS:
            continue
        for folder in children(spark, f"{path}/{table}"):
            version = folder.partition("=")[2]
            if version and version not in live:
                delete(spark, f"{path}/{table}/{folder}")
                gone.add(version)
    latest = _finished(spark, path)[-1]
    for number in children(spark, f"{path}/{MANIFESTS}"):
        if number != latest:
            delete(spark, f"{path}/{MANIFESTS}/{number}")
    return sorted(gone)
