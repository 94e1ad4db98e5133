"""Queries on simulated traces. The shaped signal is the measured side; its voltage scaled by health is the trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampwise.functions.labels import capacity_label, episode_file, folder_soc, folder_thing, health_label, model_name
from ampwise.operators import align, metrics, steps
from ampwise.operators.resolution import resolution
from ampwise.plans import oracle_parts as o
from ampwise.plans.registry import query, r6
from ampwise.plans.segment_queries import RESOLUTION_SQL, SHAPED, shaped_episodes
from ampwise.schema import EPISODE, FIVES
from ampwise.session import fresh_path, stage
from ampwise.sources import series, stores, views
from ampwise.sources.series import SERIES

LEVELS = list(o.SOCS)
WORK_LEVELS = list(range(50, 105, 5))


def simulated(rows, levels=tuple(LEVELS)):
    """Stand-in for the simulator: one trace per episode and health level, 1-based ordinals, row positions."""
    return (
        rows.withColumn("soc", F.explode(F.array(*[F.lit(level) for level in levels])))
        .select(
            "thing",
            "soc",
            (F.col("month_idx") + 1).alias("month_no"),
            (F.col("ep_idx") + 1).alias("ep_no"),
            "pos",
            "current",
            (F.col("voltage") * F.col("soc") / 100.0).alias("voltage"),
        )
    )


def simulated_series(real, levels=tuple(LEVELS)):
    """The same stand-in on chunks of episodes."""
    leveled = real.select(*SERIES, "first_pos", "current", "voltage", F.explode(F.array(*[F.lit(x) for x in levels])).alias("soc"))
    return leveled.withColumn("voltage", F.transform("voltage", lambda v: v * F.col("soc") / 100.0))


def stored_series(spark, folder, levels=tuple(LEVELS)):
    """Stored series of the shaped signal's episodes and of their traces, bucketed alike."""
    _, rows, one_pass = shaped_episodes(spark, folder)
    return _saved(spark, series.episode_series(rows, FIVES, one_pass), levels)


def _saved(spark, chunks, levels):
    real = series.save(chunks, fresh_path(spark, "episodes"), keep=False)
    return real, series.save(simulated_series(real, levels), fresh_path(spark, "traces"), keep=False)


def synthetic_steps(spark, folder, levels=tuple(LEVELS)):
    """Synthetic blows of the shaped signal at each health level, one row each, staged for repeated use."""
    return stage(steps.blow_steps(*stored_series(spark, folder, levels), FIVES))


def synthetic(spark, folder, levels=tuple(LEVELS)):
    """The same as rows."""
    return steps.blow_rows(synthetic_steps(spark, folder, levels))


SYNTHETIC = (*SHAPED, o.blows(FIVES), o.traces(), o.synthetic(FIVES.blow_rows))


@query(
    "overlay_traces",
    o.chain(*SHAPED, o.traces())
    + """
    SELECT thing, soc, month_idx, ep_idx, pos, us, round(cur, 6) AS current, round(volt, 6) AS voltage FROM trace""",
)
def overlay_traces(spark, folder):
    laid = series.rows_of(steps.overlay(*stored_series(spark, folder)), ["ts", "current", "voltage"])
    return laid.select("soc", *EPISODE, "pos", F.unix_micros("ts").alias("us"), r6("current"), r6("voltage"))


@query(
    "overlay_voltage_only",
    o.chain(*SHAPED, o.traces((90,)))
    + """
    SELECT thing, soc, sum(CAST(cur AS BIGINT)) AS current_total, round(sum(volt), 3) AS voltage_total
    FROM trace GROUP BY thing, soc""",
)
def overlay_voltage_only(spark, folder):
    _, rows, _ = shaped_episodes(spark, folder)
    rows = stage(rows.select(*EPISODE, "pos", "ts", "current", "voltage"))
    laid = align.overlay(rows, simulated(rows, (90,)).withColumn("current", F.lit(0.0)), voltage_only=True)
    return laid.groupBy("thing", "soc").agg(
        F.sum(F.col("current").cast("long")).alias("current_total"), F.round(F.sum("voltage"), 3).alias("voltage_total")
    )


@query(
    "trace_length_errors",
    o.chain(*SHAPED, o.traces((100, 80)))
    + """,
    cutoff AS (SELECT * FROM trace WHERE NOT (soc = 80 AND ep_idx = 2 AND pos > 10) AND NOT (soc = 80 AND ep_idx = 3)),
    real AS (SELECT thing, month_idx, ep_idx, count(*) AS real_rows FROM ep GROUP BY ALL),
    lv AS (SELECT DISTINCT thing, soc FROM cutoff),
    got AS (SELECT thing, soc, month_idx, ep_idx, count(*) AS trace_rows FROM cutoff GROUP BY ALL)
    SELECT r.thing, lv.soc, r.month_idx, r.ep_idx, real_rows, trace_rows
    FROM real r JOIN lv ON r.thing = lv.thing
    LEFT JOIN got ON r.thing = got.thing AND lv.soc = got.soc AND r.month_idx = got.month_idx AND r.ep_idx = got.ep_idx
    WHERE real_rows IS DISTINCT FROM trace_rows""",
)
def trace_length_errors(spark, folder):
    """Traces of one level are cut short or left out, as a damaged simulator run would leave them."""
    _, rows, _ = shaped_episodes(spark, folder)
    rows = stage(rows.select(*EPISODE, "pos", "ts", "current", "voltage"))
    damaged = simulated(rows, (100, 80)).where(
        ~((F.col("soc") == 80) & (F.col("ep_no") == 3) & (F.col("pos") > 10))
        & ~((F.col("soc") == 80) & (F.col("ep_no") == 4))
    )
    return align.length_errors(rows, damaged)


@query(
    "synthetic_blows",
    o.chain(*SYNTHETIC)
    + """
    SELECT thing, soc, month_idx, ep_idx, part, blow_pos, us, round(cur, 6) AS current, round(volt, 6) AS voltage
    FROM syn""",
)
def synthetic_blows(spark, folder):
    keys = ["soc", *EPISODE, "part", "blow_pos"]
    found = steps.blow_rows(steps.blow_steps(*stored_series(spark, folder), FIVES))
    return found.select(*keys, F.unix_micros("ts").alias("us"), r6("current"), r6("voltage"))


@query(
    "health_pairs",
    o.chain(*SYNTHETIC)
    + """
    SELECT a.thing, a.soc, a.month_idx, a.ep_idx, round(sum(f.volt - a.volt), 5) AS lost,
           count(*) AS rows
    FROM syn a JOIN syn f ON f.soc = 100 AND a.soc <> 100 AND a.thing = f.thing AND a.month_idx = f.month_idx
         AND a.ep_idx = f.ep_idx AND a.part = f.part AND a.blow_pos = f.blow_pos
    GROUP BY a.thing, a.soc, a.month_idx, a.ep_idx""",
)
def health_pairs(spark, folder):
    gaps = steps.voltage_differences(synthetic_steps(spark, folder))
    return gaps.groupBy("soc", *EPISODE).agg(F.round(F.sum("difference"), 5).alias("lost"), F.count(F.lit(1)).alias("rows"))


DIFFERENCES = f"""
dif AS (
  SELECT a.soc, round(f.volt - a.volt, 9) AS difference
  FROM syn a JOIN syn f ON f.soc = 100 AND a.soc BETWEEN 50 AND 95 AND a.thing = f.thing
       AND a.month_idx = f.month_idx AND a.ep_idx = f.ep_idx AND a.part = f.part AND a.blow_pos = f.blow_pos
),
q AS (
  SELECT soc, quantile_cont(difference, 0.25) AS q1, quantile_cont(difference, 0.5) AS q2,
         quantile_cont(difference, 0.75) AS q3
  FROM dif GROUP BY soc
)"""


@query(
    "voltage_difference_boxes",
    o.chain(*SHAPED, o.blows(FIVES), o.traces(WORK_LEVELS), o.synthetic(FIVES.blow_rows), DIFFERENCES)
    + """
    SELECT q.soc, round(min(CASE WHEN difference >= q1 - 1.5e0 * (q3 - q1) AND difference <= q1 THEN difference END), 6)
             AS low,
           round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
           round(max(CASE WHEN difference <= q3 + 1.5e0 * (q3 - q1) AND difference >= q3 THEN difference END), 6) AS high
    FROM q JOIN dif ON q.soc = dif.soc GROUP BY q.soc, q1, q2, q3""",
)
def voltage_difference_boxes(spark, folder):
    gaps = stage(steps.voltage_differences(synthetic_steps(spark, folder, tuple(WORK_LEVELS))))
    gaps = gaps.withColumn("difference", F.round("difference", 9))
    boxes = metrics.box_stats(gaps, ["soc"], "difference", fences=True)
    return boxes.select("soc", *[r6(c) for c in ("low", "q1", "q2", "q3", "high")])


DEGRADE_CUTS = [(0.10, 80), (0.20, 85), (0.35, 90)]
DEGRADE_SEED = 4988
DEGRADE_DRAW = o.draw(DEGRADE_SEED, "thing", "month_idx", "ep_idx")
DEGRADE_SQL = f"""
deg AS (
  SELECT *, CASE WHEN u < 0.1e0 THEN 80 WHEN u < 0.2e0 THEN 85 WHEN u < 0.35e0 THEN 90 ELSE 100 END AS pick
  FROM (SELECT *, {DEGRADE_DRAW} AS u FROM syn)
)"""


@query(
    "degraded_substitution",
    o.chain(*SYNTHETIC, DEGRADE_SQL)
    + """
    SELECT thing, month_idx, ep_idx, soc, count(*) AS rows, round(avg(volt), 6) AS voltage
    FROM deg WHERE soc = pick GROUP BY thing, month_idx, ep_idx, soc""",
)
def degraded_substitution(spark, folder):
    mixed = align.substitute_degraded(synthetic(spark, folder), DEGRADE_CUTS, DEGRADE_SEED)
    return mixed.groupBy(*EPISODE, "soc").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("voltage"), "voltage"))


@query(
    "trace_comparison",
    o.chain(*SHAPED, o.traces((100, 95, 85)))
    + """
    SELECT thing, month_idx + 1 AS month_no, ep_idx + 1 AS ep_no, pos,
           round(max(CASE WHEN soc = 100 THEN volt END), 6) AS voltage_100,
           round(max(CASE WHEN soc = 95 THEN volt END), 6) AS voltage_95,
           round(max(CASE WHEN soc = 85 THEN volt END), 6) AS voltage_85
    FROM trace GROUP BY ALL""",
)
def trace_comparison(spark, folder):
    """The overlay of every thing's traces; the report shows one thing and every n-th episode of it."""
    _, rows, _ = shaped_episodes(spark, folder)
    shown = align.trace_overlay(simulated(rows, (100, 95, 85)), every=1)
    return shown.select("thing", "month_no", "ep_no", "pos", *[r6(f"voltage_{s}") for s in (100, 95, 85)])


@query(
    "trace_comparison_every_fifth",
    o.chain(*SHAPED, o.traces((100, 95, 85)))
    + """,
    e AS (SELECT thing, month_idx, ep_idx, row_number() OVER (PARTITION BY thing ORDER BY month_idx, ep_idx) AS k
          FROM (SELECT DISTINCT thing, month_idx, ep_idx FROM ep))
    SELECT thing, month_idx + 1 AS month_no, ep_idx + 1 AS ep_no, pos,
           round(max(CASE WHEN soc = 100 THEN volt END), 6) AS voltage_100,
           round(max(CASE WHEN soc = 95 THEN volt END), 6) AS voltage_95,
           round(max(CASE WHEN soc = 85 THEN volt END), 6) AS voltage_85
    FROM trace JOIN e USING (thing, month_idx, ep_idx) WHERE k % 5 = 0 GROUP BY ALL""",
)
def trace_comparison_every_fifth(spark, folder):
    """The report's rank rule, at a stride that the tables have episodes for."""
    _, rows, _ = shaped_episodes(spark, folder)
    shown = align.trace_overlay(simulated(rows, (100, 95, 85)), every=5)
    return shown.select("thing", "month_no", "ep_no", "pos", *[r6(f"voltage_{s}") for s in (100, 95, 85)])


PAIRED_TIMES = o.EPISODE_ROWS.replace("s.us,", "s.us - CASE WHEN h.ep_idx % 2 = 0 THEN s.us % 2000000 ELSE 0 END AS us,")


@query(
    "repeated_times",
    o.chain(*SHAPED[:-1], PAIRED_TIMES, o.blows(FIVES), o.traces((90,)), o.synthetic(FIVES.blow_rows))
    + " SELECT thing, soc, month_idx, ep_idx, part, blow_pos, us, round(volt, 6) AS voltage FROM syn",
)
def repeated_times(spark, folder):
    """Every second episode has its times in pairs, so that lookups by time widen its blows and they are dropped."""
    _, rows, one_pass = shaped_episodes(spark, folder)
    us = F.unix_micros("ts")
    paired = F.timestamp_micros(us - F.when(F.col("ep_idx") % 2 == 0, us % 2_000_000).otherwise(0))
    rows = rows.select(*EPISODE, "pos", paired.alias("ts"), "current", "voltage")
    real, traces = _saved(spark, series.episode_series(rows, FIVES, one_pass), (90,))
    found = steps.blow_rows(steps.blow_steps(real, traces, FIVES))
    return found.select("soc", *EPISODE, "part", "blow_pos", F.unix_micros("ts").alias("us"), r6("voltage"))


BLOW_MAE = """
sy AS (
  SELECT soc, thing, month_idx, ep_idx, part, blow_pos,
         (cur - c_lo) * 2 / (c_hi - c_lo) - 1 AS c, (volt - v_lo) * 2 / (v_hi - v_lo) - 1 AS v
  FROM syn CROSS JOIN sc
),
bm AS (
  SELECT a.thing, a.month_idx, a.ep_idx, a.soc,
         round(sum(abs(a.c - f.c) + abs(a.v - f.v)) / (2e0 * count(*)), 9) AS mae
  FROM sy a JOIN sy f ON f.soc = 100 AND a.soc <> 100 AND a.thing = f.thing AND a.month_idx = f.month_idx
       AND a.ep_idx = f.ep_idx AND a.part = f.part AND a.blow_pos = f.blow_pos
  GROUP BY a.thing, a.month_idx, a.ep_idx, a.soc
)"""
FULL_BOUNDS = o.BOUNDS.format(source="syn WHERE soc = 100")


def _blow_mae(spark, folder):
    found = synthetic_steps(spark, folder)
    return steps.blow_mae(found, steps.fit_bounds(found.where(F.col("soc") == 100)))


@query(
    "blow_mae",
    o.chain(*SYNTHETIC, FULL_BOUNDS, BLOW_MAE)
    + " SELECT thing, month_idx, ep_idx, soc, round(mae, 6) AS mae FROM bm",
)
def blow_mae(spark, folder):
    return _blow_mae(spark, folder).select(*EPISODE, "soc", r6("mae"))


@query(
    "blow_mae_quartiles",
    o.chain(*SYNTHETIC, FULL_BOUNDS, BLOW_MAE)
    + """
    SELECT soc, round(quantile_cont(mae, 0.25), 6) AS q1, round(quantile_cont(mae, 0.5), 6) AS q2,
           round(quantile_cont(mae, 0.75), 6) AS q3 FROM bm GROUP BY soc""",
)
def blow_mae_quartiles(spark, folder):
    errors = stage(_blow_mae(spark, folder))
    return metrics.quartiles(errors).select("soc", r6("q1"), r6("q2"), r6("q3"))


@query("resolution_synthetic", o.chain(*SHAPED, o.traces()) + RESOLUTION_SQL.format("trace"))
def resolution_synthetic(spark, folder):
    _, rows, _ = shaped_episodes(spark, folder)
    rows = stage(rows.select(*EPISODE, "pos", "ts", "current", "voltage"))
    table = resolution(align.overlay(rows, simulated(rows)))
    return table.withColumns({"min_value": r6("min_value"), "max_value": r6("max_value")})


WORK_SQL = """CAST(round(386e0 * soc / 100e0) AS INTEGER) AS max_capacity,
           CAST(round(68e0 * soc / 100e0) AS INTEGER) AS discharge_rate,
           CAST(round(326e0 * soc / 100e0) AS INTEGER) AS normal_operating,
           CAST(round(95e0 * soc / 100e0) AS INTEGER) AS exponential_zone,
           CAST(round(340e0 * soc / 100e0) AS INTEGER) AS nominal_capacity"""


@query(
    "simulation_work",
    o.chain(*SHAPED)
    + f""",
    n AS (SELECT thing, month_idx, ep_idx, count(*) - 1 AS stop_time FROM ep GROUP BY ALL)
    SELECT thing, month_idx, ep_idx, soc, stop_time, {WORK_SQL} FROM n CROSS JOIN {o.level_table(WORK_LEVELS)}""",
)
def simulation_work(spark, folder):
    _, rows, _ = shaped_episodes(spark, folder)
    sizes = rows.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("rows"))
    return align.simulation_work(sizes, WORK_LEVELS)


@query(
    "simulation_parameters",
    f"""SELECT CAST(s_suppkey AS VARCHAR) AS thing, soc, {WORK_SQL}
        FROM supplier CROSS JOIN {o.level_table(WORK_LEVELS)}""",
)
def simulation_parameters(spark, folder):
    things = views.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("thing"))
    return align.simulation_work(things, WORK_LEVELS)


@query(
    "folder_names",
    f"""
    WITH f AS (SELECT 'E' || s_suppkey || '_' || soc AS folder, s_suppkey, soc
               FROM supplier CROSS JOIN {o.level_table()})
    SELECT folder, CAST(s_suppkey AS VARCHAR) AS thing, soc,
           'Enc_13_Synthetic_100_Dense_K_' || s_suppkey AS model, s_suppkey || '_' || soc || '.csv' AS file,
           'SOH ' || soc AS label, CAST(floor(340 * (100 - 5 * ((100 - soc) // 5)) / 100) AS INTEGER) AS capacity
    FROM f""",
)
def folder_names(spark, folder):
    named = (
        views.table(spark, folder, "supplier")
        .withColumn("soc", F.explode(F.array(*[F.lit(s) for s in LEVELS])))
        .withColumn("folder", F.concat(F.lit("E"), F.col("s_suppkey"), F.lit("_"), F.col("soc")))
    )
    return named.select(
        "folder",
        folder_thing(F.concat("folder", F.lit(".d"))).alias("thing"),
        folder_soc(F.concat("folder", F.lit(".d"))).alias("soc"),
        model_name(F.lit(13), F.lit("Dense"), F.col("s_suppkey")).alias("model"),
        episode_file(F.col("s_suppkey"), F.col("soc")).alias("file"),
        health_label(F.col("soc")).alias("label"),
        capacity_label(((100 - F.col("soc")) / 5).cast("int")).alias("capacity"),
    )


@query(
    "mixed_age_things",
    f"""
    WITH b AS (SELECT n_name AS thing, soc, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
               CROSS JOIN {o.level_table((100, 95, 90, 85, 80, 75))}),
    k AS (SELECT thing, row_number() OVER (ORDER BY thing) AS rk FROM (SELECT DISTINCT thing FROM b))
    SELECT thing, soc, c_custkey FROM b JOIN k USING (thing)
    WHERE soc = CASE WHEN rk <= 15 THEN 100 WHEN rk <= 23 THEN 95 WHEN rk <= 27 THEN 90 WHEN rk <= 29 THEN 85
                     WHEN rk = 30 THEN 80 ELSE 75 END""",
)
def mixed_age_things(spark, folder):
    customers = views.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = views.table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("thing"))
    levels = F.explode(F.array(*[F.lit(s) for s in (100, 95, 90, 85, 80, 75)]))
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("soc", levels)
    return stores.mixed_age(rows.select("thing", "soc", "c_custkey"))
