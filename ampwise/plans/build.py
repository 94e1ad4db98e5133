"""From sensor files to stored episodes, simulator exchange, and stored synthetic blows."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.operators import episodes, segment, steps
from ampwise.operators.ordering import MAX_GROUP_ROWS
from ampwise.schema import EPISODE, FIVES, Params
from ampwise.session import fresh_path, small, stage
from ampwise.sources import exchange_csv, series, snapshots, stores, telemetry_csv

log = logging.getLogger(__name__)


def build_episodes(
    spark: SparkSession,
    folder: str,
    root: str,
    p: Params = FIVES,
    mode: str = segment.SWAB_TO_SWAB,
    force: bool = False,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame | None:
    """Store the episodes of every file without a stored result (of every file when forced).

    Returns the status totals per thing, or None when there was nothing to do. Files are parsed once in their life: the
    lines are staged as Parquet, each branch reads only its columns, the search for faulty lines skips row groups without
    any, and what became of a file is stored, so that rejected and empty files are not opened again until they change.
    """
    if not telemetry_csv.is_folder(spark, folder):
        return None
    path, seen_at = telemetry_csv.episode_store_path(root, p.suffix), telemetry_csv.file_store_path(root, p.suffix)
    done = None if force else stores.stored_things(spark, path)
    seen = None if force else snapshots.entries(spark, seen_at)
    paths = telemetry_csv.pending_paths(spark, folder, done, seen)
    if not paths:
        return None
    listed = telemetry_csv.files(spark, folder).where(F.col("path").isin(paths))
    raw = stage(telemetry_csv.read_raw(spark, paths))
    rejected = stage(telemetry_csv.rejected_things(raw))
    telemetry = telemetry_csv.clean(raw, rejected)
    hot = segment.find_hot_months(telemetry, max_rows)
    found = stage(segment.candidates(telemetry, p, mode, hot))
    months = segment.months(telemetry)
    heads = segment.headers(found, months, in_pieces=hot is not None)
    stores.save_episodes(episodes.episode_rows(telemetry, heads, p, hot), months, path, with_episodes=heads)
    snapshots.commit(seen_at, ["thing"], telemetry_csv.verdicts(raw, listed, rejected), {})
    return segment.status_totals(found)


def export_for_simulator(
    spark: SparkSession, folder: str, root: str, target: str, p: Params = FIVES
) -> DataFrame | None:
    """Build what is missing and write one file per episode, under the things' own names."""
    build_episodes(spark, folder, root, p)
    rows = stores.load_episodes(spark, telemetry_csv.episode_store_path(root, p.suffix))
    if rows is None:
        return None
    named = rows.drop("name").join(small(episodes.thing_names(rows, "name")), "thing")
    exchange_csv.export_episodes(named.withColumn("thing", F.col("name")), target)
    return named


def import_synthetic(spark: SparkSession, traces_folder: str, root: str, p: Params = FIVES) -> None:
    """Turn simulator traces into stored synthetic blows, one partition per health level and thing.

    A trace that is missing, of another length than its episode, or of a thing or episode that is not stored stops the
    import. Episodes and traces are shuffled once, into series that then meet bucket by bucket.
    """
    rows = stores.load_episodes(spark, telemetry_csv.episode_store_path(root, p.suffix))
    if rows is None:
        return
    traces = exchange_csv.read_traces(spark, traces_folder)
    simulated = small(traces.select("thing").distinct())
    unknown = simulated.join(rows.select("thing").distinct(), "thing", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"traces of things that are not stored, for example {[r.thing for r in unknown]}")
    real = rows.select(*EPISODE, "pos", "ts", "current", "voltage").join(simulated, "thing", "left_semi")
    episodes_at, traces_at = fresh_path(spark, "episode-series"), fresh_path(spark, "trace-series")
    stored = series.save(series.episode_series(real, p, one_pass=False), episodes_at, keep=False)
    laid = series.save(series.trace_series(traces), traces_at, keep=False)
    examples = steps.length_errors(stored, laid).limit(5).collect()
    if examples:
        raise ValueError(f"traces do not fit their episodes, for example {examples}")
    found = steps.blow_rows(steps.blow_steps(stored, laid, p))
    stores.save_blows(found, telemetry_csv.blow_store_path(root, p.suffix))
