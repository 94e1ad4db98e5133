"""Work that must not grow faster than its rows: folders of stores, lookups of short files, tables sent to the driver."""

import gzip
import os
from urllib.parse import unquote

from pyspark.sql import functions as F

from ampwise.operators import episodes, metrics
from ampwise.schema import FIVES
from ampwise.sources import exchange_csv, named_files, stores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_population_is_not_sent_to_the_driver(spark, tmp_path):
    """A file of scores may be small and hold many of them."""
    made = spark.range(300).select(
        F.lit("K_1").alias("model"), F.explode(F.array(F.lit(100), F.lit(95))).alias("soc"),
        F.col("id").alias("sample_id"), F.lit(0.5).alias("mae"),
    )
    made.write.parquet(str(tmp_path / "scores"))
    found = metrics.stream_population(spark.read.parquet(str(tmp_path / "scores")))
    # The one broadcast is of a row per partition, the offsets of the numbering.
    assert plan(found).count("SortMergeJoin") == 2 and plan(found).count("BroadcastHashJoin") == 1
    assert 0 < found.count() <= 300


def test_rows_of_episodes_are_not_sent_to_the_driver(spark, tmp_path):
    rows = spark.range(200).select(
        F.lit("a").alias("thing"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"),
        F.lit(1.0).alias("current"), F.lit(2.0).alias("voltage"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    head = [("a", 1970, 1, 0, 0, 10_000_000, 10, 90_000_000, 90), ("a", 1970, 1, 0, 1, 150_000_000, 150, 170_000_000, 170)]
    heads = spark.createDataFrame(head, "thing string, year int, month int, month_idx int, ep_idx int, from_us long, from_seq long, to_us long, to_seq long")
    heads.write.parquet(str(tmp_path / "heads"))
    read = [spark.read.parquet(str(tmp_path / n)) for n in ("rows", "heads")]
    found = episodes.episode_rows(*read, FIVES)
    assert "BroadcastHashJoin" not in plan(found)
    got = sorted((r.ep_idx, r.pos, r.seq) for r in found.collect())
    assert got == [(0, i, 10 + i) for i in range(80)] + [(1, i, 150 + i) for i in range(20)]


def test_stores_have_a_bounded_number_of_folders(spark, tmp_path):
    things = 3 * stores.SHARDS
    rows = spark.range(2 * things).select(
        F.format_string("%03d", F.col("id") % things).alias("thing"), F.lit(0).alias("month_idx"),
        F.floor(F.col("id") / things).cast("int").alias("ep_idx"), F.lit(0).alias("pos"), F.lit(0).alias("blow_pos"), F.lit(90).alias("soc"),
    )
    months = rows.select("thing", F.lit(2024).alias("year"), F.lit(1).alias("month"), "month_idx").distinct()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    at, blows = str(tmp_path / "episodes"), str(tmp_path / "blows")
    stores.save_episodes(rows.mapInArrow(count, rows.schema), months, at)
    assert seen.value == 2 * things  # the rows are made once, the manifest comes from what was written
    stores.save_blows(rows, blows)
    for folder in (f"{at}/rows", f"{blows}/blows/{os.listdir(blows + '/blows')[0]}/soc=90"):
        below = [d for d, _, names in os.walk(folder) if any(n.endswith(".parquet") for n in names)]
        assert 1 < len(below) <= stores.SHARDS
    assert stores.load_episodes(spark, at).count() == stores.load_blows(spark, blows, 90).count() == 2 * things
    one = stores.load_episodes(spark, at, "007")
    assert one.columns == rows.columns and sorted((r.thing, r.ep_idx) for r in one.collect()) == [("007", 0), ("007", 1)]
    assert "thing_shard" in plan(one).partition("PartitionFilters")[2]
    assert stores.load_months(spark, at).where("has_episodes").count() == things


def lines_of(frame):
    return sorted(tuple(r) for r in frame.select("path", "pos", "filled", "kind", "current", "voltage").collect())


def test_short_files_are_read_as_spark_reads_them(spark, tmp_path, monkeypatch):
    contents = {
        "E1_90/1_1.csv": b"1,2\r\n,3\r\n\r\n4,5", "E1_90/1_2.csv": b"", "E 2%20+_90/1_1.csv": b"\xef\xbb\xbf1,2\n\n3,4\n\n\n",
        "deep/er/E\u00e9_80/2_1.csv": b"1\r2,x\n", "3_1.csv": b"7,8\n\n", ".hidden/1_1.csv": b"9,9\n", "E1_90/_part.csv": b"9,9\n",
    }
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = lines_of(exchange_csv._lines_in_blocks(spark, str(tmp_path)))
    blocks, left = exchange_csv._lines_in_blocks, []
    monkeypatch.setattr(exchange_csv, "_lines_in_blocks", lambda *a: left.append(a[1]) or blocks(*a))
    got = lines_of(exchange_csv._numbered_lines(spark, str(tmp_path)))
    plain = lambda found: sorted((unquote(p).replace("file:///", "file:/"), *r) for p, *r in found)
    assert plain(want) == plain(got) and len(got) == 10 and left == []
    (tmp_path / "E1_90" / "4_1.csv.gz").write_bytes(gzip.compress(b"5,6\n"))
    got = lines_of(exchange_csv._numbered_lines(spark, str(tmp_path)))
    assert len(left) == 1 and len(got) == 11 and [r[4:] for r in got if "4_1" in r[0]] == [(5.0, 6.0)]


def test_simulator_input_skips_header_and_blank_lines(spark, tmp_path):
    (tmp_path / "T").mkdir()
    (tmp_path / "T" / "1_2.csv").write_text(f"{exchange_csv.HEADER}\n1.5,2\n\n,3\n\n")
    sent = exchange_csv.read_simulator_input(spark, str(tmp_path))
    assert sorted(map(tuple, sent.collect()), key=str) == [("T", 1, 2, 1.5), ("T", 1, 2, None)]
    assert sent.schema["current"].dataType.simpleString() == "float"


def test_published_folders_are_swept(spark, tmp_path):
    lines = spark.range(40).select(F.format_string("d%d/%d.csv", F.col("id") % 20, F.col("id")).alias("file"), F.lit(0).alias("pos"), F.lit("x").alias("line"))
    assert named_files.write_named(lines, str(tmp_path)).count() == 40
    assert sorted(os.listdir(tmp_path)) == sorted(f"d{k}" for k in range(20))
