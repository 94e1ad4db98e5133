"""Round trips through the files and stores: what is read back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampwise.operators import segment
from ampwise.plans import evaluate
from ampwise.plans import oracle_parts as o
from ampwise.plans.metric_queries import SWEEP, SWEEP_COLUMNS, THRESHOLDS, _rounded_sweep, _thresholds
from ampwise.plans.registry import query, r6
from ampwise.plans.segment_queries import SHAPED, SIX_HOURS, SLOW, SLOW_EPISODES, line_episodes, shaped_episodes
from ampwise.plans.synthetic_queries import SYNTHETIC, simulated, synthetic
from ampwise.schema import CURRENT_FIELD, EPISODE, FILE_COLUMNS, VOLTAGE_FIELD
from ampwise.session import fresh_path
from ampwise.sources import exchange_csv, named_files, stores, telemetry_csv, views


def _sensor_lines(telemetry, current=None, stamp=None):
    """Cells of the sensor layout, in file order."""
    given = {
        "TSTAMP": F.date_format("ts", "yyyy-MM-dd HH:mm:ss") if stamp is None else stamp,
        "THING": F.col("thing"),
        CURRENT_FIELD: F.col("current") if current is None else current,
        VOLTAGE_FIELD: F.col("voltage"),
    }
    return [given.get(c, F.lit(1.5)).cast("string").alias(c) for c in FILE_COLUMNS]


@query(
    "sensor_files",
    o.chain(o.EVENTS)
    + """
    SELECT thing AS name, epoch_us(date_trunc('second', ts)) AS us,
           round(CAST(CAST(cur AS FLOAT) AS DOUBLE), 4) AS current,
           round(CAST(CAST(volt AS FLOAT) AS DOUBLE), 4) AS voltage
    FROM tel""",
)
def sensor_files(spark, folder):
    """Headerless gzip CSV in the sensor layout, written and scanned back."""
    telemetry, _ = views.events_telemetry(spark, folder)
    lines = telemetry.select(*_sensor_lines(telemetry))
    path = fresh_path(spark, "sensor-files")
    lines.write.option("header", False).option("compression", "gzip").csv(path)
    rows = telemetry_csv.clean(telemetry_csv.read_raw(spark, path))
    return rows.select(
        "name", F.unix_micros("ts").alias("us"), F.round("current", 4).alias("current"), F.round("voltage", 4).alias("voltage")
    )


@query(
    "faulty_files",
    o.chain(o.EVENTS)
    + """,
    bad AS (SELECT DISTINCT thing FROM tel WHERE seq % 7 = 0 AND CAST(thing AS INTEGER) % 5 IN (0, 1))
    SELECT 'u' || thing AS thing, thing AS name, epoch_us(date_trunc('second', ts)) AS us,
           round(CAST(CAST(cur AS FLOAT) AS DOUBLE), 4) AS current
    FROM tel WHERE thing NOT IN (SELECT thing FROM bad)
      AND NOT (seq % 7 = 0 AND CAST(thing AS INTEGER) % 5 IN (2, 3))""",
)
def faulty_files(spark, folder):
    """One file per thing, named apart from it. Every seventh row is faulty in one of four ways.

    A line with a cell too many or a word for a number rejects the file; a missing cell or an unreadable time drops the row.
    """
    telemetry, _ = views.events_telemetry(spark, folder)
    faulty = F.col("seq") % 7 == 0
    kind = F.when(faulty, F.col("thing").cast("int") % 5)
    current = F.when(kind == 1, "much").when(kind == 2, "NA").otherwise(F.col("current").cast("string"))
    stamp = F.when(kind == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat(F.concat_ws(",", *_sensor_lines(telemetry, current, stamp)), F.when(kind == 0, ",9").otherwise(""))
    path = fresh_path(spark, "faulty-files")
    file = F.concat(F.lit("u"), "thing", F.lit(".csv"))
    named_files.write_named(telemetry.select(file.alias("file"), F.col("seq").alias("pos"), line.alias("line")), path)
    rows = telemetry_csv.clean(telemetry_csv.read_raw(spark, path))
    return rows.select("thing", "name", F.unix_micros("ts").alias("us"), F.round("current", 4).alias("current"))


@query(
    "pending_files",
    """
    SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS thing FROM lineitem WHERE l_suppkey % 3 <> 0""",
)
def pending_files(spark, folder):
    """Files an incremental build opens when every third thing has a stored result."""
    telemetry, _, rows, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    listed = telemetry.groupBy("thing").agg(F.min("seq").alias("pos"))
    files, done = fresh_path(spark, "pending-files"), F.col("thing").cast("int") % 3 == 0
    line = F.concat(F.lit("2024-01-01 00:00:00,"), F.col("thing"))
    named_files.write_named(listed.select(F.concat("thing", F.lit(".csv")).alias("file"), "pos", line.alias("line")), files)
    path = fresh_path(spark, "episodes")
    stores.save_episodes(rows.where(done), segment.months(telemetry.where(done)), path)
    pending = telemetry_csv.pending_paths(spark, files, stores.stored_things(spark, path))
    return telemetry_csv.read_raw(spark, pending).select("thing").distinct()


@query(
    "one_thing_episodes",
    o.chain(*SLOW_EPISODES, o.EPISODE_ROWS)
    + """ SELECT thing, month_idx, ep_idx, pos, us, round(cur, 6) AS current FROM ep
    WHERE thing = (SELECT min(thing) FROM head)""",
)
def one_thing_episodes(spark, folder):
    """The stored episodes of the first thing, read from its partition."""
    telemetry, _, rows, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    path = fresh_path(spark, "episodes")
    stores.save_episodes(rows, segment.months(telemetry), path)
    first = stores.load_months(spark, path).where("has_episodes").agg(F.min("thing")).first()[0]
    loaded = stores.load_episodes(spark, path, first)
    return loaded.select(*EPISODE, "pos", F.unix_micros("ts").alias("us"), r6("current"))


@query(
    "episode_store",
    o.chain(*SLOW_EPISODES, o.EPISODE_ROWS)
    + " SELECT thing, month_idx, ep_idx, pos, us, round(cur, 6) AS current FROM ep",
)
def episode_store(spark, folder):
    telemetry, _, rows, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    path = fresh_path(spark, "episodes")
    stores.save_episodes(rows, segment.months(telemetry), path)
    loaded = stores.load_episodes(spark, path)
    return loaded.select(*EPISODE, "pos", F.unix_micros("ts").alias("us"), r6("current"))


@query(
    "stored_things",
    o.chain(*SLOW_EPISODES) + " SELECT DISTINCT thing FROM cal",
)
def stored_things(spark, folder):
    """Things an incremental build would skip."""
    telemetry, _, rows, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    path = fresh_path(spark, "episodes")
    stores.save_episodes(rows, segment.months(telemetry), path)
    return stores.stored_things(spark, path)


@query(
    "simulator_stop_times",
    o.chain(*SHAPED)
    + """
    SELECT thing, month_idx + 1 AS month_no, ep_idx + 1 AS ep_no, count(*) - 1 AS stop_time
    FROM ep GROUP BY thing, month_idx, ep_idx""",
)
def simulator_stop_times(spark, folder):
    _, rows, _ = shaped_episodes(spark, folder)
    path = fresh_path(spark, "exported")
    exchange_csv.export_episodes(rows, path)
    return exchange_csv.stop_times(exchange_csv.read_simulator_input(spark, path))


@query(
    "exported_files",
    o.chain(*SHAPED)
    + """
    SELECT thing || '/' || CAST(month_idx + 1 AS VARCHAR) || '_' || CAST(ep_idx + 1 AS VARCHAR) || '.csv' AS file,
           count(*) AS rows
    FROM ep GROUP BY thing, month_idx, ep_idx""",
)
def exported_files(spark, folder):
    _, rows, _ = shaped_episodes(spark, folder)
    return exchange_csv.export_episodes(rows, fresh_path(spark, "exported"))


@query(
    "exported_episodes",
    o.chain(*SHAPED)
    + """
    SELECT thing, month_idx + 1 AS month_no, ep_idx + 1 AS ep_no, pos,
           round(CAST(CAST(cur AS FLOAT) AS DOUBLE), 3) AS current,
           round(CAST(CAST(volt AS FLOAT) AS DOUBLE), 3) AS voltage
    FROM ep""",
)
def exported_episodes(spark, folder):
    """Header and values of the exported files, read back under their positions."""
    _, rows, _ = shaped_episodes(spark, folder)
    path = fresh_path(spark, "exported")
    exchange_csv.export_episodes(rows, path)
    back = exchange_csv.read_episodes(spark, path)
    return back.select("thing", "month_no", "ep_no", "pos", *[F.round(c, 3).alias(c) for c in ("current", "voltage")])


@query(
    "simulator_traces",
    o.chain(*SHAPED, o.traces((90, 80)))
    + """
    SELECT thing, soc, month_idx + 1 AS month_no, ep_idx + 1 AS ep_no, CAST(pos AS INTEGER) AS pos,
           round(CAST(CAST(cur AS FLOAT) AS DOUBLE), 3) AS current,
           round(CAST(CAST(volt AS FLOAT) AS DOUBLE), 3) AS voltage
    FROM trace""",
)
def simulator_traces(spark, folder):
    """Traces in the simulator's layout, read back with thing, level and ordinals from their paths."""
    traces = _trace_files(spark, folder, (90, 80))
    return traces.select(
        "thing", "soc", "month_no", "ep_no", "pos", *[F.round(c, 3).alias(c) for c in ("current", "voltage")]
    )


@query(
    "simulator_voltages",
    o.chain(*SHAPED, o.traces((90,)))
    + """
    SELECT thing, soc, month_idx + 1 AS month_no, ep_idx + 1 AS ep_no, CAST(pos AS INTEGER) AS pos,
           round(CAST(CAST(volt AS FLOAT) AS DOUBLE), 3) AS voltage
    FROM trace""",
)
def simulator_voltages(spark, folder):
    """The single-column reading of traces."""
    shown = exchange_csv.voltages(_trace_files(spark, folder, (90,)))
    return shown.withColumn("voltage", F.round("voltage", 3))


def _traces(spark, folder, levels):
    """Rows of an episode are together before levels multiply them. Where they are by then, as in months not cut, Spark leaves
    the shuffle out.
    """
    _, rows, _ = shaped_episodes(spark, folder)
    return simulated(rows.repartition(*EPISODE), levels)


def _trace_files(spark, folder, levels):
    path = fresh_path(spark, "traces")
    exchange_csv.export_traces(_traces(spark, folder, levels), F.concat(F.lit("E"), "thing"), path, together=True)
    return exchange_csv.read_traces(spark, path)


@query(
    "synthetic_store",
    o.chain(*SYNTHETIC)
    + """
    SELECT thing, soc, month_idx, ep_idx, part, blow_pos, round(volt, 6) AS voltage FROM syn WHERE soc = 90""",
)
def synthetic_store(spark, folder):
    path = fresh_path(spark, "synthetic")
    stores.save_blows(synthetic(spark, folder), path)
    loaded = stores.load_blows(spark, path, 90)
    return loaded.select("soc", *EPISODE, "part", "blow_pos", r6("voltage"))


@query(
    "evaluation_store",
    o.chain(o.SCORES, THRESHOLDS)
    + """
    SELECT model, 'score' AS kind, CAST(sample_id AS BIGINT) AS id, soc, round(mae, 6) AS value FROM scores
    UNION ALL SELECT model, 'threshold', CAST(pct AS BIGINT), 100, round(threshold, 6) FROM thr""",
)
def evaluation_store(spark, folder):
    """All stored scores and all stored thresholds."""
    scores, limits = stores.load_evaluation(spark, _stored_evaluation(spark, folder))
    scored = scores.select("model", F.lit("score").alias("kind"), F.col("sample_id").cast("long").alias("id"), "soc", r6("mae", "value"))
    cuts = limits.select("model", F.lit("threshold").alias("kind"), F.col("pct").cast("long").alias("id"), F.lit(100).alias("soc"), r6("threshold", "value"))
    return scored.unionByName(cuts)


@query(
    "stored_boxes",
    o.chain(o.SCORES)
    + """
    SELECT model, soc, CAST(floor(340 * soc / 100) AS INTEGER) AS capacity, round(quantile_cont(mae, 0.1), 6) AS p10,
           round(quantile_cont(mae, 0.5), 6) AS q2, round(quantile_cont(mae, 0.9), 6) AS p90
    FROM scores GROUP BY model, soc""",
)
def stored_boxes(spark, folder):
    boxes, _ = evaluate.stored_report(spark, _stored_evaluation(spark, folder))
    return boxes.select("model", "soc", "capacity", r6("p10"), r6("q2"), r6("p90"))


@query("stored_rates", o.chain(o.SCORES, THRESHOLDS, SWEEP) + f" SELECT {SWEEP_COLUMNS} FROM sweep WHERE pct = 87")
def stored_rates(spark, folder):
    _, rates = evaluate.stored_report(spark, _stored_evaluation(spark, folder))
    return _rounded_sweep(rates)


@query(
    "cached_thresholds",
    o.chain(o.SCORES, THRESHOLDS) + " SELECT model, pct, round(threshold, 6) AS threshold FROM thr",
)
def cached_thresholds(spark, folder):
    """A stored table is returned as it is unless it is forced: the second builder would halve the thresholds."""
    path = fresh_path(spark, "thresholds")
    build = lambda: _thresholds(views.order_scores(spark, folder))
    stores.cached_table(spark, path, build, force=False)
    half = lambda: build().withColumn("threshold", F.col("threshold") / 2)
    return stores.cached_table(spark, path, half, force=False).select("model", "pct", r6("threshold"))


def _stored_evaluation(spark, folder):
    scores = views.order_scores(spark, folder)
    path = fresh_path(spark, "evaluation")
    stores.save_evaluation(path, scores, _thresholds(scores))
    return path
