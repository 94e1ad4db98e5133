"""Series stores: episodes and traces as arrays in bucketed tables that meet without a shuffle.

A row holds up to ``CHUNK_ROWS`` positions of one episode, so rows are few and of bounded size however long an episode is.
Tables of episodes and of their traces are bucketed alike on (thing, month, episode, chunk): joined on exactly those
columns, every bucket meets its counterpart in one task and neither side moves. The key is fine, so no thing and no month
makes a bucket hot. A table is shuffled once, when it is written, and read as often as needed.

Bucketing is known from the session's catalog. A store keeps its layout beside its data, so that another session can
register the table again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampwise.operators.blows import anchors
from ampwise.schema import EPISODE, Params

CHUNK_ROWS = 256
SERIES = [*EPISODE, "chunk"]
STATS = ["ep_rows", "first_dis", "first_chg"]


def chunked(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = EPISODE) -> DataFrame:
    """Rows with a ``pos`` as chunks: ``chunk``, ``first_pos`` and an array of each value, in the order of ``pos``."""
    chunk = F.floor(F.col("pos") / CHUNK_ROWS).cast("int").alias("chunk")
    steps = F.sort_array(F.collect_list(F.struct("pos", *values)))  # array_sort compares by an interpreted lambda
    packed = rows.groupBy(*keys, chunk).agg(steps.alias("_steps"))
    arrays = [F.col("_steps")[v].alias(v) for v in values]  # a field of all entries
    return packed.select(*keys, "chunk", F.get("_steps", F.lit(0))["pos"].alias("first_pos"), *arrays)


def rows_of(chunks: DataFrame, values: Sequence[str]) -> DataFrame:
    """Chunks as rows again; other columns are repeated."""
    kept = [c for c in chunks.columns if c not in (*values, "chunk", "first_pos")]
    out = chunks.select(*kept, "first_pos", F.posexplode(F.arrays_zip(*values)).alias("_at", "_row"))
    return out.select(*kept, (F.col("first_pos") + F.col("_at")).cast("int").alias("pos"), "_row.*")


def episode_series(rows: DataFrame, p: Params, one_pass: bool = True) -> DataFrame:
    """Episode rows ``(thing, month_idx, ep_idx, pos, ts, current, voltage)`` as chunks with what blows need to know.

    Every chunk carries its episode's length and the positions of its first discharge and charge row. Rows that are
    already dealt by episode are not shuffled again; see ``blows.anchors`` for ``one_pass``.
    """
    held = anchors(rows.select(*EPISODE, "pos", "ts", "current", "voltage"), p, one_pass)
    return chunked(held, ["ts", "current", "voltage"], [*EPISODE, *STATS])


def repeated_episodes(real: DataFrame) -> DataFrame:
    """Episodes in which a time may occur again in the thing: inside a chunk, or where chunks overlap in time.

    Times rise along a month, of which episodes are stretches, so a time that occurs in two chunks makes these, or the
    next one in order, overlap. Only times are read, and one span per chunk is windowed.
    """
    spans = real.select(
        *SERIES,
        F.get("ts", F.lit(0)).alias("first"),
        F.element_at("ts", -1).alias("last"),
        (F.size(F.array_distinct("ts")) < F.size("ts")).alias("inside"),
    )
    along = Window.partitionBy("thing", "month_idx").orderBy("first", "ep_idx", "chunk")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("first")
    after = F.lead("first").over(along) <= F.col("last")
    again = F.col("inside") | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    return spans.select(*EPISODE, again.alias("again")).where("again").select(*EPISODE).distinct()


def trace_series(traces: DataFrame) -> DataFrame:
    """Traces ``(thing, soc, month_no, ep_no, pos, current, voltage)`` as chunks under the keys of their episodes."""
    keyed = traces.withColumns({"month_idx": F.col("month_no") - 1, "ep_idx": F.col("ep_no") - 1})
    return chunked(keyed, ["current", "voltage"], ["soc", *EPISODE])


def _table_name(path: str) -> str:
    return f"ampwise_series_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def save(chunks: DataFrame, path: str, buckets: int | None = None, keep: bool = True) -> DataFrame:
    """Write chunks as a bucketed table at ``path`` and return it. Tables that are to meet need equal ``buckets``.

    Chunks are dealt by the bucket hash first, so that every bucket becomes one file. Without ``keep`` no layout is
    written: the table serves this session only.
    """
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _table_name(path)
    writer = chunks.repartition(buckets, *SERIES).write.format("parquet").mode("overwrite")
    writer.bucketBy(buckets, *SERIES).sortBy(*SERIES).option("path", f"{path}/data").saveAsTable(name)
    table = spark.table(name)
    if keep:
        layout = spark.createDataFrame([(table.schema.json(), buckets)], "schema string, buckets int")
        layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return table


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, registered with its buckets if this session does not know it yet."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema("schema string, buckets int").json(f"{path}/layout").first()
        fields = T.StructType.fromJson(json.loads(layout["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        keys = ", ".join(SERIES)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/data'"
        )
    return spark.table(name)
