"""A transactional sink for text files under given names.

Spark's own writers choose the names of their files, but an exchange needs one file per episode under the episode's name.
The sink is a Python data source with a commit in three steps:

1. Every task attempt writes complete files into a hidden folder of its own, with an index of them, and reports that folder
   in its commit message. A lost or repeated attempt leaves nothing that anybody reads. Hidden files are numbered: under
   their own folders, each attempt would make nearly every folder, as many as files and as much disk.
2. When all tasks are done, the commit writes one list of the reported folders and moves it into place. That move is the
   point from which the job counts; a job that fails before it is aborted and its hidden folder deleted.
3. The listed files are moved to their names by Spark tasks. Moves can be repeated, so a driver lost halfway leaves a
   list that ``recover`` finishes; a list that is missing means that nothing of the job was published.

The driver sees one line per task, never one per file.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ampwise.session import stage

# The Python classes of this module travel with their tasks, so executors need pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "named_text_files"
PENDING = ".pending-"
COMMITTED, INDEX = "committed.txt", "index.json"
PUBLISHED = "file string, rows long"
# Names that every file system takes are not tried out: such files are hidden under numbers, so many to a folder.
PLAIN = re.compile(r"([A-Za-z0-9][A-Za-z0-9._-]{0,99}/)*[A-Za-z0-9][A-Za-z0-9._-]{0,99}")
FOLDER_FILES = 1000


def _write_whole(system: fs.FileSystem, path: str, text: str) -> None:
    """A file that is either complete under its name or not there."""
    hidden = f"{path}-{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(text.encode())
    system.move(hidden, path)


def _hidden_name(file: str, number: int) -> str:
    """Where an attempt keeps its ``number``-th file. Odd names are used as they are, so that a bad one fails in the writer."""
    return f"{number // FOLDER_FILES}/{number}" if PLAIN.fullmatch(file) else f"named/{file}"


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task attempt that wrote all its files."""

    folder: str


class _AttemptWriter(DataSourceArrowWriter):
    """Writes rows ``(file, line)``, the rows of a file next to each other, in their order."""

    def __init__(self, pending: str, header: str | None):
        self.pending, self.header = pending, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, root = fs.FileSystem.from_uri(self.pending)
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0}-{uuid.uuid4().hex}"
        index, out, made = [], None, None  # files, their rows and where they are hidden
        try:
            for batch in iterator:
                files, lines = batch.column("file").to_pylist(), batch.column("line").to_pylist()
                first = 0
                while first < len(files):
                    after = first + 1
                    while after < len(files) and files[after] == files[first]:
                        after += 1
                    if not index or index[-1][0] != files[first]:
                        if out is not None:
                            out.close()
                        hidden = _hidden_name(str(files[first]), len(index))
                        path = f"{root}/{name}/{hidden}"
                        if (parent := path.rpartition("/")[0]) != made:
                            system.create_dir(parent, recursive=True)
                            made = parent
                        index.append([files[first], 0, hidden])
                        out = system.open_output_stream(path)
                        if self.header is not None:
                            out.write(f"{self.header}\n".encode())
                    out.write("".join(f"{line}\n" for line in lines[first:after]).encode())
                    index[-1][1] += after - first
                    first = after
        finally:
            if out is not None:
                out.close()
        if index:
            _write_whole(system, f"{root}/{name}/{INDEX}", json.dumps(index))
        return Attempt(name if index else "")

    def commit(self, messages: Sequence[Attempt | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.pending)
        system.create_dir(root, recursive=True)
        _write_whole(system, f"{root}/{COMMITTED}", "".join(f"{m.folder}\n" for m in messages if m and m.folder))

    def abort(self, messages: Sequence[Attempt | None]) -> None:
        _delete(self.pending)


class NamedTextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _AttemptWriter(self.options["path"], self.options.get("header"))


def _delete(folder: str) -> None:
    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)


def _publisher(pending: str, target: str):
    """Move the files of committed attempts to their names; what was moved before is left as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, hidden = fs.FileSystem.from_uri(pending)
        _, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                with system.open_input_stream(f"{hidden}/{attempt}/{INDEX}") as stream:
                    index = json.loads(stream.read())
                made = set()
                for file, _, name in index:
                    source, path = f"{hidden}/{attempt}/{name}", f"{root}/{file}"
                    parent = path.rpartition("/")[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    if system.get_file_info(source).type == fs.FileType.File:
                        system.move(source, path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, *_ in index], pa.string()), pa.array([n for _, n, _ in index], pa.int64())],
                    names=["file", "rows"],
                )

    return run


def _sweeper(pending: str):
    """Delete the folders of attempts, emptied by then; one that is gone already is no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, hidden = fs.FileSystem.from_uri(pending)
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                if system.get_file_info(f"{hidden}/{attempt}").type == fs.FileType.Directory:
                    system.delete_dir(f"{hidden}/{attempt}")
            yield batch

    return run


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as the session's file system names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def _publish(spark: SparkSession, pending: str, target: str) -> DataFrame:
    """Publish a committed job and drop its hidden folder."""
    attempts = spark.read.schema("attempt string").text(f"{pending}/{COMMITTED}").where(F.col("attempt") != "")
    spread = attempts.repartition(max(1, spark.sparkContext.defaultParallelism))
    published = stage(spread.mapInArrow(_publisher(pending, target), PUBLISHED))
    # All attempts together can have very many folders, too many to delete one by one here.
    spread.mapInArrow(_sweeper(pending), "attempt string").count()
    _delete(pending)
    return published


def _ordered(lines: DataFrame, together: bool) -> DataFrame:
    dealt = lines.select("file", "pos", "line")
    return (dealt if together else dealt.repartition("file")).sortWithinPartitions("file", "pos").select("file", "line")


def write_named(lines: DataFrame, folder: str, header: str | None = None, together: bool = False) -> DataFrame:
    """Write the ``line`` of each row to its ``file`` below ``folder``, in the order of ``pos``; return ``(file, rows)``.

    All files appear, or, if the job fails, none; files of the same name are replaced. ``folder`` is a URI that pyarrow
    opens on the executors. ``together`` says that all rows of a file lie in one partition, so that they need no shuffle.
    """
    spark = lines.sparkSession
    spark.dataSource.register(NamedTextFiles)
    target = qualified(spark, folder)
    pending = f"{target}/{PENDING}{uuid.uuid4().hex}"
    writer = _ordered(lines, together).write.format(FORMAT).mode("append")
    (writer if header is None else writer.option("header", header)).save(pending)
    return _publish(spark, pending, target)


def recover(spark: SparkSession, folder: str) -> list[str]:
    """Finish jobs whose driver was lost: publish what was committed, delete the rest. For when no job is writing.

    Returns the hidden folders that were published.
    """
    target = qualified(spark, folder)
    system, root = fs.FileSystem.from_uri(target)
    if system.get_file_info(root).type != fs.FileType.Directory:
        return []
    names = [info.base_name for info in system.get_file_info(fs.FileSelector(root)) if info.base_name.startswith(PENDING)]
    done = []
    for name in names:
        if system.get_file_info(f"{root}/{name}/{COMMITTED}").type == fs.FileType.File:
            _publish(spark, f"{target}/{name}", target)
            done.append(name)
        else:
            _delete(f"{target}/{name}")
    return done
