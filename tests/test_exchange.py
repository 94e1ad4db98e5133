"""Exchange files: jobs that fail, tasks that are lost, drivers that are lost, and files read in blocks."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from ampwise.operators import episodes, segment
from ampwise.plans import store_queries
from ampwise.schema import FIVES
from ampwise.session import stage
from ampwise.sources import exchange_csv, named_files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def lines(spark, files=6, rows=40):
    made = spark.range(files * rows).select(
        F.format_string("d%d/%d.csv", F.col("id") % 2, F.floor(F.col("id") / rows)).alias("file"),
        (F.col("id") % rows).alias("pos"),
    )
    return made.withColumn("line", F.format_string("%s-%d", "file", "pos"))


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    broken = F.when((F.col("pos") == 39) & F.col("file").endswith("5.csv"), F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        named_files.write_named(lines(spark).withColumn("line", F.coalesce(broken.cast("string"), "line")), target)
    assert tree(tmp_path) == []
    odd = lines(spark).withColumn("file", F.when(F.col("file") == "d1/5.csv", "x" * 300).otherwise(F.col("file")))
    with pytest.raises(Exception, match="File name too long"):  # fails in the writer, next to tasks that succeed
        named_files.write_named(odd, target)
    assert tree(tmp_path) == [] and os.listdir(target) == []


def test_a_lost_attempt_leaves_no_stray_file(tmp_path):
    """The worker of one task dies after it has written whole files and begun another; the task is run again."""
    script = f"""
    import os, sys
    sys.path[:0] = [{ROOT!r}, {os.path.join(ROOT, "tests")!r}]
    from pyspark.sql import SparkSession, functions as F
    from ampwise.sources import named_files
    from test_exchange import lines
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
    flag = {str(tmp_path / "died")!r}
    write = named_files._AttemptWriter.write

    def dying(self, batches):
        def some():
            for batch in batches:
                for k in range(0, batch.num_rows, 25):
                    if k >= 50 and not os.path.exists(flag):
                        open(flag, "w").close()
                        os._exit(1)
                    yield batch.slice(k, 25)

        return write(self, some())

    named_files._AttemptWriter.write = dying
    found = named_files.write_named(lines(spark).coalesce(1), {str(tmp_path / "out")!r}, "head")
    assert sorted((r.file, r.rows) for r in found.collect()) == sorted(
        (r.file, r.n) for r in lines(spark).groupBy("file").agg(F.count("*").alias("n")).collect())
    spark.stop()
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=200, cwd=ROOT)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(tmp_path / "died")
    written = tree(tmp_path / "out")
    assert [f for f in written if not f.endswith(".crc")] == sorted({f"d{k % 2}/{k // 40}.csv" for k in range(240)})
    for file in written:
        part = (tmp_path / "out" / file).read_text().splitlines()
        assert part[0] == "head" and len(part) == len(set(part)) and all(p.startswith(f"{file}-") for p in part[1:])


def test_a_lost_driver_is_recovered(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(named_files, "_publish", lost)
    with pytest.raises(KeyboardInterrupt):
        named_files.write_named(lines(spark), target)
    monkeypatch.undo()
    assert not [f for f in tree(target) if not f.startswith(named_files.PENDING)]
    os.makedirs(os.path.join(target, f"{named_files.PENDING}early", "0-a"))  # a job that had not committed
    assert len(named_files.recover(spark, target)) == 1
    assert tree(target) == sorted({f"d{k % 2}/{k // 40}.csv" for k in range(240)})
    assert (tmp_path / "out" / "d0" / "0.csv").read_text().splitlines()[0] == "d0/0.csv-0"
    assert named_files.recover(spark, target) == [] and named_files.recover(spark, str(tmp_path / "none")) == []


def test_hidden_files_do_not_take_a_folder_each(spark, tmp_path, monkeypatch):
    """Nearly every attempt gets a file of every thing; were it hidden under the thing's folder, folders would outnumber files."""
    target, things, long = str(tmp_path / "out"), 60, "n" * 240
    names = [f"E{t}_90/1_{e}.csv" for t in range(things) for e in range(5)] + [f"E{t} +%_80/{long}{t}.csv" for t in range(2)] + [".e/_1.csv"]
    rows = [(name, pos, f"{name}-{pos}") for name in names for pos in (1, 0)]
    monkeypatch.setattr(named_files, "_publish", lambda *_: None)
    monkeypatch.setattr(named_files, "FOLDER_FILES", 40)
    named_files.write_named(spark.createDataFrame(rows, "file string, pos int, line string").repartition(4), target)
    monkeypatch.undo()
    folders = sum(len(below) for _, below, _ in os.walk(target))
    assert 4 <= folders <= 40
    assert len(named_files.recover(spark, target)) == 1
    assert tree(target) == sorted(names)
    assert all((tmp_path / "out" / name).read_text() == f"{name}-0\n{name}-1\n" for name in names)


def cycles(spark, things=3, ticks=400):
    """Things in a cycle of 40 seconds, ten each of rest, discharge, charge and rest."""
    phase = F.floor(F.col("seq") % 40 / 10)
    made = spark.range(things * ticks).select(F.concat(F.lit("t"), F.col("id") % things).alias("thing"), F.floor(F.col("id") / things).alias("seq"))
    level = F.when(phase == 0, 0.0).when(phase == 1, -20.0).when(phase == 2, 20.0).otherwise(1.0)
    return made.select("thing", F.timestamp_seconds("seq").alias("ts"), "seq", level.alias("current"), (F.col("seq") / 4).alias("voltage"))


def test_traces_are_written_where_their_episodes_lie(spark, tmp_path, monkeypatch):
    def shaped(limit):
        telemetry = stage(cycles(spark))
        hot = segment.find_hot_months(telemetry, limit)
        assert (hot is None) == (limit > 400)
        return (*episodes.find_episodes(telemetry, FIVES, hot=hot), hot is None)

    got = {}
    for limit in (1000, 90):  # whole months, and months cut into pieces
        monkeypatch.setattr(store_queries, "shaped_episodes", lambda *_, n=limit: shaped(n))
        traces = store_queries._traces(spark, None, (90, 80))
        lines = exchange_csv.trace_lines(traces, F.concat(F.lit("E"), "thing"))
        moved = [named_files._ordered(lines, together)._jdf.queryExecution().executedPlan().toString() for together in (True, False)]
        if limit == 1000:
            rows = shaped(limit)[1]._jdf.queryExecution().executedPlan().toString()
            assert moved[0].count("Exchange hashpartitioning") == rows.count("Exchange hashpartitioning") < moved[1].count("Exchange hashpartitioning")
        target = str(tmp_path / str(limit))
        files = {r.file: r.rows for r in exchange_csv.export_traces(traces, F.concat(F.lit("E"), "thing"), target, together=True).collect()}
        back = exchange_csv.read_traces(spark, target)
        want = {(r.thing, r.soc, r.month_no, r.ep_no, r.pos): (r.current, round(r.voltage, 3)) for r in traces.collect()}
        got[limit] = {(r.thing, r.soc, r.month_no, r.ep_no, r.pos): (r.current, round(r.voltage, 3)) for r in back.collect()}
        assert got[limit] == want and back.count() == len(want) == sum(files.values())
        assert sorted(files) == sorted({f"E{t}_{s}/{m}_{e}.csv" for t, s, m, e, _ in want}) == tree(target)
    assert got[1000] == got[90] and len(got[90]) > 500


def test_a_long_trace_is_read_in_blocks_with_its_positions(spark, tmp_path):
    folder = tmp_path / "E7_90"
    folder.mkdir()
    rows = 30_000
    (folder / "1_1.csv").write_text("".join(f"{i}.5,{i * 2}\n" for i in range(rows)) + "\n\n")
    (folder / "1_2.csv").write_bytes(b"1,2\r\n,3\r\n\r\n4,5")
    (folder / "2_1.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        blocks = spark.read.text(str(tmp_path), recursiveFileLookup=True).select("_metadata.file_block_start").distinct().count()
        found = exchange_csv.read_traces(spark, str(tmp_path)).orderBy("month_no", "ep_no", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 4
    long = [r for r in found if r.ep_no == 1]
    assert [(r.pos, r.current, r.voltage) for r in long] == [(i, i + 0.5, 2.0 * i) for i in range(rows)]
    assert [(r.pos, r.current, r.voltage) for r in found if r.ep_no == 2] == [(0, 1.0, 2.0), (1, None, 3.0), (2, None, None), (3, 4.0, 5.0)]
    assert {(r.thing, r.soc) for r in found} == {("7", 90)} and len(found) == rows + 4
    (folder / "3_1.csv").write_text("1,2\nhello,3\n")
    with pytest.raises(Exception, match="not a trace"):
        exchange_csv.read_traces(spark, str(tmp_path)).collect()
