import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from ampwise.functions.labels import capacity_label, folder_soc, folder_thing
from ampwise.plans import build
from ampwise.schema import MEASURES, Params
from ampwise.sources import exchange_csv, snapshots, stores, telemetry_csv

TWOS = Params(2, 2, 2, 2)
T0 = dt.datetime(2024, 3, 1)
LEVELS = {"D": -20.0, "S": 0.0, "C": 20.0}
SIGNAL = "DSSDDCCSSSSDSSSDDCCSSSSDS"


def line(thing, second, current, voltage=24.0, stamp=None):
    stamp = stamp or (T0 + dt.timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S")
    values = ["1.5"] * (len(MEASURES) - 2) + [str(current), str(voltage)]
    return ",".join([stamp, thing, *values])


def write(folder, name, lines):
    with gzip.open(os.path.join(folder, name), "wt") as out:
        out.write("\n".join(lines) + ("\n" if lines else ""))


@pytest.fixture
def folder(tmp_path):
    target = tmp_path / "dataset"
    target.mkdir()
    signal = [line("E007", i, LEVELS[c], 20 + i / 10) for i, c in enumerate(SIGNAL)]
    write(target, "007.gz", list(reversed(signal)))
    write(target, "101.gz", [line("E101", i, LEVELS[c]) for i, c in enumerate(SIGNAL)] + ["2024-03-01 01:00:00,E101,1"])
    write(target, "wide.gz", [line("Ewide", 0, 1.0), line("Ewide", 1, 1.0) + ",9"])
    write(target, "word.gz", [line("Eword", 0, 1.0), line("Eword", 1, "abc")])
    write(
        target,
        "gaps.gz",
        [line("Egaps", 0, "NA"), line("Egaps", 1, ""), line("Egaps", 2, 5.0, stamp="soon"), line("Egaps", 3, 6.0)],
    )
    write(target, "empty.gz", [])
    return str(target)


def test_scan_rejects_whole_files_and_drops_null_rows(spark, folder):
    raw = telemetry_csv.read_raw(spark, folder)
    assert {r.thing for r in telemetry_csv.rejected_things(raw).collect()} == {"wide", "word"}
    rows = telemetry_csv.clean(raw)
    counts = {r.thing: r["count"] for r in rows.groupBy("thing").count().collect()}
    assert counts == {"007": len(SIGNAL), "101": len(SIGNAL), "gaps": 1}
    assert {r.name for r in rows.where("thing = '007'").collect()} == {"E007"}
    assert rows.schema["CONF"].dataType.simpleString() == "float"


def test_scan_and_load_do_not_shuffle_rows_by_thing(spark, folder, tmp_path):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "hashpartitioning" not in plan(telemetry_csv.clean(telemetry_csv.read_raw(spark, folder)))
    build.build_episodes(spark, folder, str(tmp_path), TWOS)
    path = telemetry_csv.episode_store_path(str(tmp_path), TWOS.suffix)
    for thing in (None, "007"):
        assert "hashpartitioning" not in plan(stores.load_episodes(spark, path, thing))


def test_incremental_build_opens_only_new_files(spark, folder, tmp_path):
    root = str(tmp_path)
    totals = {r.thing: r.asDict() for r in build.build_episodes(spark, folder, root, TWOS).collect()}
    assert totals["007"]["valid"] == totals["101"]["valid"] == 2
    path = telemetry_csv.episode_store_path(root, TWOS.suffix)
    assert path.endswith("episodes_2_2_2_2")
    done = stores.stored_things(spark, path)
    pending = [os.path.basename(p) for p in telemetry_csv.pending_paths(spark, folder, done)]
    # Rejected and empty files have no result, so they are looked at again.
    assert pending == ["empty.gz", "wide.gz", "word.gz"]
    before = stores.load_episodes(spark, path).count()
    write(folder, "200.gz", [line("E200", i, LEVELS[c]) for i, c in enumerate(SIGNAL)])
    assert {r.thing for r in build.build_episodes(spark, folder, root, TWOS).collect()} == {"200"}
    assert stores.load_episodes(spark, path).count() == before * 3 // 2
    write(folder, "101.gz", [line("E101", i, 0.0) for i in range(9)])
    build.build_episodes(spark, folder, root, TWOS, force=True)
    loaded = stores.load_episodes(spark, path)
    assert loaded.count() == before and {r.thing for r in loaded.select("thing").distinct().collect()} == {"007", "200"}
    assert stores.load_episodes(spark, path, "101") is None


def test_files_are_opened_once_until_they_change(spark, folder, tmp_path, monkeypatch):
    root, opened = str(tmp_path), []
    real = telemetry_csv.read_raw

    def watched(session, paths):
        opened.append(sorted(os.path.basename(p) for p in paths))
        return real(session, paths)

    monkeypatch.setattr(telemetry_csv, "read_raw", watched)
    build.build_episodes(spark, folder, root, TWOS)
    everything = ["007.gz", "101.gz", "empty.gz", "gaps.gz", "wide.gz", "word.gz"]
    assert opened == [everything]
    found = snapshots.entries(spark, telemetry_csv.file_store_path(root, TWOS.suffix))
    verdicts = {r.thing: (r.lines, r.reason) for r in found.collect()}
    size = len(SIGNAL)
    assert verdicts == {"007": (size, None), "101": (size + 1, None), "empty": (0, "empty"), "gaps": (4, None), "wide": (2, "fields"), "word": (2, "cell")}
    assert build.build_episodes(spark, folder, root, TWOS) is None and len(opened) == 1
    write(folder, "word.gz", [line("Eword", i, LEVELS[c]) for i, c in enumerate(SIGNAL)])
    write(folder, "new.gz", [line("Enew", 0, 1.0)])
    totals = build.build_episodes(spark, folder, root, TWOS).collect()
    assert opened[1:] == [["new.gz", "word.gz"]] and {r.thing: r.valid for r in totals} == {"word": 2}
    assert build.build_episodes(spark, folder, root, TWOS) is None and len(opened) == 2
    build.build_episodes(spark, folder, root, TWOS, force=True)
    assert opened[2] == sorted([*everything, "new.gz"])


def test_loads_warn_instead_of_failing(spark, folder, tmp_path, caplog):
    assert build.build_episodes(spark, str(tmp_path / "nowhere"), str(tmp_path)) is None
    path = telemetry_csv.episode_store_path(str(tmp_path), TWOS.suffix)
    assert stores.load_episodes(spark, path) is None
    build.build_episodes(spark, folder, str(tmp_path), TWOS)
    assert stores.load_episodes(spark, path, "nobody") is None
    assert stores.load_episodes(spark, path, "007").select("thing").distinct().first().thing == "007"
    assert "no episodes" in caplog.text


def test_exchange_with_the_simulator(spark, folder, tmp_path):
    root, exported = str(tmp_path), str(tmp_path / "exported")
    build.export_for_simulator(spark, folder, root, exported, TWOS)
    written = (tmp_path / "exported" / "E007" / "1_1.csv").read_text().splitlines()
    assert written[0] == "S_CORRBATT_FLG1,S_TENSBATT_FLG1" and written[1].count(",") == 1
    assert not [f for f in os.listdir(tmp_path / "exported" / "E007") if f.startswith(".")]
    sent = exchange_csv.read_simulator_input(spark, exported)
    stops = {(r.thing, r.month_no, r.ep_no): r.stop_time for r in exchange_csv.stop_times(sent).collect()}
    rows = stores.load_episodes(spark, telemetry_csv.episode_store_path(root, TWOS.suffix))
    sizes = {("E" + r.thing, r.month_idx + 1, r.ep_idx + 1): r["rows"] - 1 for r in exchange_csv.episode_row_counts(rows).collect()}
    assert stops == sizes and stops
    traces = tmp_path / "traces"
    for (name, month, episode), stop in stops.items():
        for soc in (100, 80):
            target = traces / f"{name}_{soc}"
            target.mkdir(parents=True, exist_ok=True)
            values = [f"{-1.5 * i},{soc / 4 + i}" for i in range(stop + 1)]
            (target / f"{month}_{episode}.csv").write_text("\n".join(values) + "\n")
    trace = exchange_csv.read_traces(spark, str(traces))
    first = {r.pos: (r.current, r.voltage) for r in trace.where("thing = '007' and soc = 80 and ep_no = 1").collect()}
    assert first[0] == (0.0, 20.0) and first[3] == (-4.5, 23.0) and len(first) == stops[("E007", 1, 1)] + 1
    assert exchange_csv.voltages(trace).where("thing = '007' and soc = 80 and ep_no = 1 and pos = 3").first().voltage == 23.0
    build.import_synthetic(spark, str(traces), root, TWOS)
    store = telemetry_csv.blow_store_path(root, TWOS.suffix)
    assert store.endswith("synthetic_2_2_2_2")
    blows = stores.load_blows(spark, store, 80)
    widths = blows.groupBy("thing", "month_idx", "ep_idx").count().collect()
    assert {r.thing for r in widths} == {"007", "101"} and {r["count"] for r in widths} == {TWOS.blow_rows}
    assert stores.load_blows(spark, store).select("soc").distinct().count() == 2
    (traces / "E007_80" / "1_1.csv").write_text("1,2\n")
    with pytest.raises(ValueError, match="do not fit"):
        build.import_synthetic(spark, str(traces), root, TWOS)


def test_exported_files_keep_odd_names_rows_and_order(spark, tmp_path):
    rows = spark.createDataFrame(
        [(t, 0, e, i, float(-i), None if i == 2 else i / 4) for t in ("a b+c%", "7") for e in range(3) for i in range(50)],
        "thing string, month_idx int, ep_idx int, pos int, current double, voltage double",
    ).orderBy(F.rand(1))
    target = str(tmp_path / "out")
    for _ in range(2):  # files of the same name are replaced
        files = exchange_csv.export_episodes(rows, target)
        assert sorted((r.file, r.rows) for r in files.collect()) == sorted((f"{t}/1_{e}.csv", 50) for t in ("a b+c%", "7") for e in (1, 2, 3))
    back = exchange_csv.read_episodes(spark, target)
    got = {(r.thing, r.month_no, r.ep_no, r.pos): (r.current, r.voltage) for r in back.collect()}
    assert got == {(r.thing, 1, r.ep_idx + 1, r.pos): (r.current, r.voltage) for r in rows.collect()}
    (tmp_path / "out" / "7" / "1_1.csv").write_text("x,y\n1,2\n")
    with pytest.raises(Exception, match="not an exported episode"):
        exchange_csv.read_episodes(spark, target).collect()


def test_folder_names(spark):
    df = spark.createDataFrame([("E464001_100",), ("X1_95.zip",)], "f string")
    got = [(r.t, r.s) for r in df.select(folder_thing(F.col("f")).alias("t"), folder_soc(F.col("f")).alias("s")).collect()]
    assert got == [("464001", 100), ("1", 95)]
    labels = spark.range(5).select(capacity_label(F.col("id")).alias("q")).collect()
    assert [r.q for r in labels] == [340, 323, 306, 289, 272]


def test_mixed_age_staircase(spark):
    things = [f"t{i:02d}" for i in range(1, 32)]
    levels = (100, 95, 90, 85, 80, 75)
    df = spark.createDataFrame([(t, s) for t in things for s in levels], "thing string, soc int")
    got = {r.thing: r.soc for r in stores.mixed_age(df).collect()}
    want = [100] * 15 + [95] * 8 + [90] * 4 + [85] * 2 + [80, 75]
    assert [got[t] for t in things] == want
    extra = df.unionByName(spark.createDataFrame([("t99", 100)], "thing string, soc int"))
    with pytest.raises(ValueError):
        stores.mixed_age(extra)


def test_evaluation_curve_and_history_stores(spark, tmp_path):
    scores = spark.createDataFrame([("K_1", 100, "a", 0.5), ("K_2", 95, "a", 0.7)], "model string, soc int, sample_id string, mae double")
    thresholds = spark.createDataFrame([("K_1", 87, 0.6)], "model string, pct int, threshold double")
    path = str(tmp_path / "evaluation")
    stores.save_evaluation(path, scores, thresholds)
    loaded, limits = stores.load_evaluation(spark, path, "K_1")
    assert loaded.count() == limits.count() == 1
    calls = []

    def build_table():
        calls.append(1)
        return scores

    curve = str(tmp_path / "curve")
    for force in (False, False, True):
        assert stores.cached_table(spark, curve, build_table, force).count() == 2
    assert len(calls) == 2
    history = spark.range(450).select(
        F.lit("K_1").alias("model"), F.col("id").alias("epoch"), F.explode(F.array(F.lit("loss"), F.lit("val_loss"))).alias("metric"), F.lit(0.1).alias("value")
    )
    stores.save_history(history, str(tmp_path / "history"))
    shown = stores.learning_curve(spark.read.parquet(str(tmp_path / "history"))).collect()
    assert sorted((r.metric, r.epoch) for r in shown) == [("loss", 0)] + [("val_loss", e) for e in range(0, 400, 50)]
