"""CSV exchange with the battery simulator: one file per episode, ``<folder>/<month>_<episode>.csv``."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampwise.functions.labels import episode_file, folder_soc, folder_thing
from ampwise.schema import CURRENT_FIELD, EPISODE, VOLTAGE_FIELD
from ampwise.session import small, stage
from ampwise.sources.named_files import qualified, write_named

# The Python functions of this module travel with their tasks, so executors need pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Files up to this size are read whole by the task that lists their folder; longer ones by Spark, in its blocks.
SHORT_BYTES = 4 << 20
BATCH_BYTES = 1 << 20
LISTED = "path string, short boolean, lines array<binary>"
HEADER = f"{CURRENT_FIELD},{VOLTAGE_FIELD}"


def _pairs(rows: DataFrame, file: Column) -> DataFrame:
    """Current and voltage of each file's rows, as lines."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("current", "voltage")]
    return rows.select(file.alias("file"), "pos", F.concat_ws(",", *cells).alias("line"))


def export_episodes(rows: DataFrame, folder: str) -> DataFrame:
    """One headered file per episode, ``<thing>/<month>_<episode>.csv`` with both ordinals from 1."""
    file = episode_file(F.col("month_idx") + 1, F.col("ep_idx") + 1)
    return write_named(_pairs(rows, F.concat_ws("/", "thing", file)), folder, HEADER)


def trace_lines(traces: DataFrame, name: Column) -> DataFrame:
    """Lines of traces under their files in the simulator's layout, ``<name>_<soc>/<month>_<episode>.csv``."""
    soc = F.col("soc").cast("string")
    return _pairs(traces, F.concat(name, F.lit("_"), soc, F.lit("/"), episode_file(F.col("month_no"), F.col("ep_no"))))


def export_traces(traces: DataFrame, name: Column, folder: str, together: bool = False) -> DataFrame:
    """Traces in the simulator's layout without a header. ``together``: all rows of a trace lie in one partition."""
    return write_named(trace_lines(traces, name), folder, together=together)


def _path_parts(path: str = "_metadata.file_path") -> Column:
    """Names along the file's path, as they were written: Spark shows the path with its escapes."""
    return F.split(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), "/")


def _ordinal(file: Column, group: int) -> Column:
    return F.regexp_extract(file, r"^(\d+)_(\d+)", group).cast("int")


def _hidden(name: str) -> bool:
    """What Spark's readers skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _children(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            if batch.num_rows:
                names = [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if not _hidden(i.base_name)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def _short_files(uri: str, limit: int):
    """Files below the named children of a folder; short ones with their lines, blank ones at the end left out."""

    def below(system: fs.FileSystem, info: fs.FileInfo) -> Iterator[fs.FileInfo]:
        if info.type != fs.FileType.Directory:
            yield info
            return
        for child in system.get_file_info(fs.FileSelector(info.path)):
            if not _hidden(child.base_name):
                yield from below(system, child)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        shown, found, held = quote(uri, safe="/:"), [], 0

        def packed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.bool_(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["path", "short", "lines"])

        for batch in batches:
            for name in batch.column("name").to_pylist():
                for info in below(system, system.get_file_info(f"{root}/{name}")):
                    path = f"{shown}/{quote(info.path[len(root) + 1 :])}"
                    # Other endings may be packed, which Spark unpacks.
                    if info.size > limit or info.extension != "csv":
                        found.append((path, False, None))
                        continue
                    with system.open_input_stream(info.path, compression=None) as stream:
                        lines = stream.read().removeprefix(b"\xef\xbb\xbf").splitlines()
                    while lines and not lines[-1]:
                        lines.pop()
                    found.append((path, True, lines))
                    held += info.size + len(path)
                    if held > BATCH_BYTES:
                        yield packed()
                        found, held = [], 0
        if found:
            yield packed()

    return run


def _numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines ``(path, pos, filled, kind, current, voltage)`` of all files below ``folder``, numbered from 0 in each.

    Exchange folders hold very many short files, which Spark's reader lists and opens at a cost far above their content. So
    tasks list the folders in it and read short files as they find them; long ones are left to Spark's reader, as is the
    whole folder where pyarrow doesn't open it. Blank lines at the end of a file don't count. ``kind`` marks header lines and
    lines with a cell that is no number.
    """
    uri = qualified(spark, folder)
    try:
        system, root = fs.FileSystem.from_uri(uri)
        listable = system.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        listable = False
    if not listable:
        return _lines_in_blocks(spark, folder)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = 4 * max(1, spark.sparkContext.defaultParallelism)
    children = spark.range(0, 1, 1, 1).mapInArrow(_children(uri), "name string").repartition(tasks, "name")
    listed = stage(children.mapInArrow(_short_files(uri, min(split, SHORT_BYTES)), LISTED))
    lines = listed.where("short").select("path", F.posexplode("lines").alias("pos", "value"))
    short = lines.withColumn("value", F.col("value").cast("string")).select("path", "pos", *_parsed())
    long = [F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")]
    paths = sorted(r.path for r in listed.where(~F.col("short")).select(*long).collect())
    return short.unionByName(_lines_in_blocks(spark, paths)) if paths else short


def _parsed() -> list[Column]:
    cells = F.split("value", ",")

    def cell(i: int) -> Column:
        return F.nullif(F.get(cells, F.lit(i)), F.lit(""))

    def number(i: int) -> Column:
        return cell(i).try_cast("float").cast("double")

    odd = [cell(i).isNotNull() & number(i).isNull() for i in (0, 1)]
    return [
        (F.col("value") != "").alias("filled"),
        F.when(F.col("value") == HEADER, "header").when(odd[0] | odd[1], "odd").alias("kind"),
        number(0).alias("current"),
        number(1).alias("voltage"),
    ]


def _lines_in_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Spark reads files in blocks, long ones in several tasks, and hands out ids that rise along a block. The parsed lines
    are staged with those; the lines of the earlier blocks of a file, one count per block, are added to the place in the
    own block. So no file is held in one row or read by one task only.
    """
    lines = spark.read.text(paths, recursiveFileLookup=True)
    parsed = stage(
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            *_parsed(),
        )
    )
    blocks = parsed.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("seq").alias("first"),
        F.max(F.when(F.col("filled"), F.col("seq"))).alias("last"),
    )
    whole = Window.partitionBy("path")
    before = F.coalesce(F.sum("lines").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.withColumn("offset", before - F.col("first"))
    offsets = offsets.select("path", "block", "offset", F.max(F.col("last") + F.col("offset")).over(whole).alias("end"))
    placed = parsed.join(small(offsets), ["path", "block"]).withColumn("pos", F.col("seq") + F.col("offset"))
    kept = placed.where(F.col("pos") <= F.col("end"))
    return kept.select("path", F.col("pos").cast("int").alias("pos"), "filled", "kind", "current", "voltage")


def _located(lines: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """Lines with the parts of their path; the folder's name, and the file's ordinals."""
    located = lines.withColumn("parts", _path_parts("path"))
    file = F.element_at("parts", -1)
    return located, F.element_at("parts", -2), [_ordinal(file, 1).alias("month_no"), _ordinal(file, 2).alias("ep_no")]


def _refused(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join("parts", "/"))).cast("boolean")


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Simulator traces ``<x><thing>_<soc>/<month>_<episode>.csv`` with their line positions; other lines are an error."""
    located, name, ordinals = _located(_numbered_lines(spark, folder))
    sound = located.where(F.when(F.col("kind").isNull(), True).otherwise(_refused("not a trace")))
    return sound.select(folder_thing(name).alias("thing"), folder_soc(name).alias("soc"), *ordinals, "pos", "current", "voltage")


def read_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Exported episodes with their row positions; a file with another header, or a line without numbers, is an error."""
    located, name, ordinals = _located(_numbered_lines(spark, folder))
    # The check of line 0 decides whether it is dropped, so that it can't be left out.
    headed = F.when(F.col("kind") == "header", False).otherwise(_refused("not an exported episode"))
    sound = F.when(F.col("kind").isNull(), True).otherwise(_refused("not a row of an episode"))
    body = located.where(F.when(F.col("pos") == 0, headed).otherwise(sound))
    return body.select(name.alias("thing"), *ordinals, (F.col("pos") - 1).alias("pos"), "current", "voltage")


def voltages(trace: DataFrame) -> DataFrame:
    """The single-column reading of a trace: the second column, under its position."""
    return trace.select("thing", "soc", "month_no", "ep_no", "pos", "voltage")


def read_simulator_input(spark: SparkSession, folder: str) -> DataFrame:
    """Currents of exported episodes, header skipped; the simulator reads nothing else."""
    located, name, ordinals = _located(_numbered_lines(spark, folder))
    body = located.where((F.col("pos") > 0) & F.col("filled"))
    return body.select(name.alias("thing"), *ordinals, F.col("current").cast("float").alias("current"))


def stop_times(simulator_input: DataFrame) -> DataFrame:
    """The simulation runs from 0 to the row count less one."""
    return simulator_input.groupBy("thing", "month_no", "ep_no").agg(
        (F.count(F.lit(1)) - 1).alias("stop_time")
    )


def episode_row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("rows"))
