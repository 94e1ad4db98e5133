"""Signal, segmentation, episode and blow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampwise.functions.signal import (
    count_where,
    date_label,
    is_charge,
    is_discharge,
    is_rest,
    past_discharge,
    time_label,
)
from ampwise.operators import blows, episodes, segment
from ampwise.operators.resolution import resolution
from ampwise.plans import oracle_parts as o
from ampwise.plans.registry import query, r6
from ampwise.schema import FIVES, MONTH, Params
from ampwise.sources import views

EVENT_CLOCK = Params(1, 1, 1, 1, gap_s=1, period_s=40_000)
EVENT_PAIRS = Params(1, 1, 2, 2, gap_s=1, period_s=40_000)
ONES = Params(1, 1, 1, 1)
TWOS = Params(2, 2, 2, 2)
SIX_HOURS = 21_600
SLOW = Params(1, 1, 1, 1, gap_s=SIX_HOURS, period_s=SIX_HOURS)


def shaped_episodes(spark, folder, tick_s: int = 1):
    """Episode headers and rows of the shaped signal, and whether months had to be split."""
    telemetry, hot = views.shaped_telemetry(spark, folder, tick_s, staged=True)
    return (*episodes.find_episodes(telemetry, FIVES, hot=hot), hot is None)


def line_episodes(spark, folder, tick_s: int = 1, p: Params = ONES):
    telemetry, hot = views.line_telemetry(spark, folder, tick_s, staged=True)
    return (telemetry, *episodes.find_episodes(telemetry, p, hot=hot), hot is None)


@query(
    "telemetry_clean",
    o.chain(o.EVENTS)
    + """
    SELECT thing, seq, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, epoch_us(ts) AS us,
           strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock,
           round(CAST(CAST(cur AS FLOAT) AS DOUBLE), 4) AS current
    FROM tel WHERE thing IS NOT NULL AND ts IS NOT NULL AND cur IS NOT NULL AND volt IS NOT NULL""",
)
def telemetry_clean(spark, folder):
    telemetry, _ = views.events_telemetry(spark, folder)
    return telemetry.dropna("any").select(
        "thing",
        "seq",
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.unix_micros("ts").alias("us"),
        date_label(F.col("ts")).alias("day"),
        time_label(F.col("ts")).alias("clock"),
        F.round(F.col("current").cast("float").cast("double"), 4).alias("current"),
    )


@query(
    "signal_states",
    o.chain(o.lines())
    + """
    SELECT thing, count(*) FILTER (WHERE cur <= -10) AS discharge, count(*) FILTER (WHERE cur >= 10) AS charge,
           count(*) FILTER (WHERE cur BETWEEN -10 AND 10) AS rest, count(*) FILTER (WHERE cur > -10) AS past_discharge
    FROM tel GROUP BY thing""",
)
def signal_states(spark, folder):
    telemetry, _ = views.line_telemetry(spark, folder)
    return telemetry.groupBy("thing").agg(
        count_where(is_discharge(ONES)).alias("discharge"),
        count_where(is_charge(ONES)).alias("charge"),
        count_where(is_rest(ONES)).alias("rest"),
        count_where(past_discharge(ONES)).alias("past_discharge"),
    )


STATUS_SQL = """
    SELECT thing, count(*) FILTER (WHERE status = 'valid') AS valid,
           count(*) FILTER (WHERE status = 'inconsistent') AS inconsistent,
           count(*) FILTER (WHERE status = 'incomplete') AS incomplete,
           count(*) FILTER (WHERE status = 'noise') AS noise, count(*) FILTER (WHERE status = 'context') AS context
    FROM cand GROUP BY thing"""


def _status(name: str, view, sql: str, p: Params, mode: str = segment.SWAB_TO_SWAB):
    clean = mode == segment.CLEAN_DISCHARGE

    @query(name, o.chain(sql, o.candidates(p, clean)) + STATUS_SQL)
    def run(spark, folder):
        telemetry, hot = view(spark, folder)
        return segment.status_totals(segment.candidates(telemetry, p, mode, hot))

    return run


status_events = _status("status_events", views.events_telemetry, o.EVENTS, EVENT_CLOCK)
_status("status_events_noise", views.events_telemetry, o.EVENTS, EVENT_PAIRS)
_status("status_lines", views.line_telemetry, o.lines(), ONES)
_status("status_lines_twos", views.line_telemetry, o.lines(), TWOS)
_status("status_shaped", views.shaped_telemetry, o.lines(shaped=True), FIVES)
_status("status_clean_discharge_events", views.events_telemetry, o.EVENTS, EVENT_CLOCK, segment.CLEAN_DISCHARGE)
_status("status_clean_discharge_lines", views.line_telemetry, o.lines(), TWOS, segment.CLEAN_DISCHARGE)


def _candidates(name: str, view, sql: str, p: Params, mode: str = segment.SWAB_TO_SWAB):
    clean = mode == segment.CLEAN_DISCHARGE

    @query(
        name,
        o.chain(sql, o.candidates(p, clean))
        + " SELECT thing, yr AS year, mo AS month, start_rn, next_rn, end_rn, status FROM cand",
    )
    def run(spark, folder):
        telemetry, hot = view(spark, folder)
        found = segment.candidates(telemetry, p, mode, hot)
        return found.select(*MONTH, "start_rn", "next_rn", "end_rn", "status")

    return run


def _slow_lines(spark, folder):
    return views.line_telemetry(spark, folder, SIX_HOURS)


_candidates("candidates_events", views.events_telemetry, o.EVENTS, EVENT_CLOCK)
_candidates("candidates_lines", views.line_telemetry, o.lines(), ONES)
_candidates("candidates_over_months", _slow_lines, o.lines(SIX_HOURS), SLOW)
_candidates("candidates_clean_discharge", _slow_lines, o.lines(SIX_HOURS), SLOW, segment.CLEAN_DISCHARGE)


@query(
    "mode_fallback",
    o.chain(o.EVENTS, o.candidates(EVENT_CLOCK)) + " SELECT status, count(*) AS n FROM cand GROUP BY status",
)
def mode_fallback(spark, folder):
    telemetry, hot = views.events_telemetry(spark, folder)
    found = segment.candidates(telemetry, EVENT_CLOCK, "no_such_mode", hot)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


SLOW_EPISODES = (o.lines(SIX_HOURS), o.candidates(SLOW), o.headers(SLOW))


@query(
    "month_calendar",
    o.chain(*SLOW_EPISODES) + " SELECT thing, yr AS year, mo AS month, month_idx FROM cal",
)
def month_calendar(spark, folder):
    telemetry, _ = _slow_lines(spark, folder)
    return segment.months(telemetry)


@query(
    "episode_headers",
    o.chain(*SLOW_EPISODES)
    + " SELECT thing, yr AS year, mo AS month, month_idx, ep_idx, start_rn, next_rn, end_rn FROM head",
)
def episode_headers(spark, folder):
    _, heads, _, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    return heads.select(*MONTH, "month_idx", "ep_idx", "start_rn", "next_rn", "end_rn")


@query(
    "episode_rows",
    o.chain(*SLOW_EPISODES, o.EPISODE_ROWS)
    + " SELECT thing, month_idx, ep_idx, pos, us, round(cur, 6) AS current, round(volt, 6) AS voltage FROM ep",
)
def episode_rows(spark, folder):
    _, _, rows, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    keys = ["thing", "month_idx", "ep_idx", "pos"]
    return rows.select(*keys, F.unix_micros("ts").alias("us"), r6("current"), r6("voltage"))


SHAPED = (o.lines(shaped=True), o.candidates(FIVES), o.headers(FIVES), o.EPISODE_ROWS)
BLOW_COLUMNS = "thing, month_idx, ep_idx, part, part_pos, blow_pos, us, round(cur, 6) AS current"


def _blow_rows(found):
    keys = ["thing", "month_idx", "ep_idx", "part", "part_pos", "blow_pos"]
    return found.select(*keys, F.unix_micros("ts").alias("us"), r6("current"))


@query("blows_shaped", o.chain(*SHAPED, o.blows(FIVES)) + f" SELECT {BLOW_COLUMNS} FROM blow")
def blows_shaped(spark, folder):
    _, rows, one_pass = shaped_episodes(spark, folder)
    return _blow_rows(blows.extract_blows(rows, FIVES, one_pass))


@query(
    "blows_lines",
    o.chain(*SLOW_EPISODES, o.EPISODE_ROWS, o.blows(SLOW)) + f" SELECT {BLOW_COLUMNS} FROM blow",
)
def blows_lines(spark, folder):
    _, _, rows, one_pass = line_episodes(spark, folder, SIX_HOURS, SLOW)
    return _blow_rows(blows.extract_blows(rows, SLOW, one_pass))


@query(
    "blow_pairs",
    o.chain(*SHAPED, o.blows(FIVES))
    + """
    SELECT thing, month_idx, ep_idx, count(*) FILTER (WHERE part = 'discharge') AS discharge_rows,
           count(*) FILTER (WHERE part = 'charge') AS charge_rows,
           min(us) FILTER (WHERE part = 'discharge') AS discharge_from, min(us) FILTER (WHERE part = 'charge') AS charge_from
    FROM blow GROUP BY thing, month_idx, ep_idx""",
)
def blow_pairs(spark, folder):
    _, rows, one_pass = shaped_episodes(spark, folder)
    found = blows.extract_blows(rows, FIVES, one_pass).withColumn("us", F.unix_micros("ts"))
    of_d, of_c = F.col("part") == "discharge", F.col("part") == "charge"
    return found.groupBy("thing", "month_idx", "ep_idx").agg(
        count_where(of_d).alias("discharge_rows"),
        count_where(of_c).alias("charge_rows"),
        F.min(F.when(of_d, F.col("us"))).alias("discharge_from"),
        F.min(F.when(of_c, F.col("us"))).alias("charge_from"),
    )


@query(
    "blows_in_months",
    o.chain(*SLOW_EPISODES, o.EPISODE_ROWS, o.blows(SLOW))
    + """
    SELECT thing, month_idx, CASE month_idx WHEN 2 THEN 0 ELSE 1 END AS month_order, ep_idx, count(*) AS rows
    FROM blow WHERE month_idx IN (2, 0) GROUP BY thing, month_idx, ep_idx""",
)
def blows_in_months(spark, folder):
    _, _, rows, one_pass = line_episodes(spark, folder, SIX_HOURS, SLOW)
    chosen = blows.in_months(rows, [2, 0])
    found = blows.extract_blows(chosen, SLOW, one_pass)
    return found.groupBy("thing", "month_idx", "month_order", "ep_idx").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "episode_summary",
    o.chain(*SLOW_EPISODES)
    + """,
    len AS (SELECT thing, month_idx, end_rn - lo AS rows FROM head),
    j AS (SELECT cal.thing, cal.month_idx, len.rows FROM cal
          LEFT JOIN len ON cal.thing = len.thing AND cal.month_idx = len.month_idx)
    SELECT CASE grouping(thing, month_idx) WHEN 0 THEN 'thing_month' WHEN 1 THEN 'thing'
                WHEN 2 THEN 'month' ELSE 'all' END AS level,
           thing, month_idx, count(rows) AS episodes, count(DISTINCT thing) AS things,
           round(avg(rows), 6) AS mean_rows, min(rows) AS min_rows, max(rows) AS max_rows
    FROM j GROUP BY GROUPING SETS ((thing, month_idx), (thing), (month_idx), ())""",
)
def episode_summary(spark, folder):
    telemetry, heads, _, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    table = episodes.summary(episodes.lengths(heads, SLOW), segment.months(telemetry))
    return table.withColumn("mean_rows", r6("mean_rows"))


@query(
    "episode_counts",
    o.chain(*SLOW_EPISODES) + " SELECT thing, count(*) AS episodes FROM head GROUP BY ROLLUP (thing)",
)
def episode_counts(spark, folder):
    _, heads, _, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    return episodes.episode_counts(heads)


@query(
    "inspect_month",
    o.chain(*SLOW_EPISODES)
    + " SELECT thing, month_idx, ep_idx, start_rn, end_rn FROM head WHERE month_idx = 1 AND ep_idx < 2",
)
def inspect_month(spark, folder):
    _, heads, _, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    shown = episodes.first_of_month(heads, 1, limit=2)
    return shown.select("thing", "month_idx", "ep_idx", "start_rn", "end_rn")


@query(
    "inspect_month_counts",
    o.chain(*SLOW_EPISODES)
    + " SELECT thing, count(*) AS episodes FROM head WHERE month_idx = 1 GROUP BY ROLLUP (thing)",
)
def inspect_month_counts(spark, folder):
    _, heads, _, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    return episodes.month_counts(heads, 1)


@query(
    "thing_names",
    o.chain(*SLOW_EPISODES, o.EPISODE_ROWS)
    + """
    SELECT thing, arg_max('E' || thing || '@' || month_idx, month_idx) AS name
    FROM ep WHERE ep_idx = 0 AND pos = 0 GROUP BY thing""",
)
def thing_names(spark, folder):
    _, _, rows, _ = line_episodes(spark, folder, SIX_HOURS, SLOW)
    named = rows.withColumn("name", F.concat(F.lit("E"), "thing", F.lit("@"), F.col("month_idx").cast("string")))
    return episodes.thing_names(named, "name")


RESOLUTION_SQL = """
    SELECT 'voltage' AS signal, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT volt) AS distinct_values,
           round(min(volt), 6) AS min_value, round(max(volt), 6) AS max_value FROM {0}
    UNION ALL
    SELECT 'current', count(*), count(DISTINCT cur), round(min(cur), 6), round(max(cur), 6) FROM {0}"""


@query("resolution_real", o.chain(*SHAPED) + RESOLUTION_SQL.format("ep"))
def resolution_real(spark, folder):
    _, rows, _ = shaped_episodes(spark, folder)
    return resolution(rows).withColumns({"min_value": r6("min_value"), "max_value": r6("max_value")})
