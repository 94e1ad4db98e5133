"""Overlay, blows and blow errors on series: whole stretches per row, joined bucket by bucket.

The row forms of these operators are in ``align``; here a trace meets its episode chunk by chunk, and a blow is one row
with its steps, an array of at most a blow's width. Only what belongs to blows is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampwise.operators.align import synthetic_blows
from ampwise.operators.blows import extract_blows, with_windows
from ampwise.operators.scaling import SENTINELS
from ampwise.schema import EPISODE, Params
from ampwise.session import small
from ampwise.sources.series import SERIES, STATS, repeated_episodes, rows_of

SAMPLE = ["soc", *EPISODE]
VALUES = ["current", "voltage"]
STEP = "array<struct<blow_pos:int,part:string,ts:timestamp,current:double,voltage:double>>"


def overlay(real: DataFrame, traces: DataFrame, voltage_only: bool = False) -> DataFrame:
    """Chunks of episodes with current and voltage of their traces, one per health level.

    Both tables are read where they lie. Run ``length_errors`` first: a trace of another length is an input error.
    """
    replaced = ["voltage"] if voltage_only else VALUES
    values = traces.select("soc", *SERIES, *replaced)
    return real.drop(*replaced).join(values, SERIES)


def length_errors(real: DataFrame, traces: DataFrame) -> DataFrame:
    """Episodes whose trace is missing or of another length, and traces without an episode."""
    expected = real.groupBy(*EPISODE).agg(F.sum(F.size("ts")).alias("real_rows"))
    found = traces.groupBy("soc", *EPISODE).agg(F.sum(F.size("voltage")).alias("trace_rows"))
    due = expected.join(found.select("thing", "soc").distinct(), "thing")
    both = due.join(found, SAMPLE, "full_outer")
    return both.where(~F.col("real_rows").eqNullSafe(F.col("trace_rows")))


def _steps_in_chunk() -> Column:
    """The steps of both parts of a blow that lie in the chunk."""

    def part(name: str, low: str, high: str, before: Column) -> Column:
        first = F.greatest(F.col(low), F.col("first_pos"))
        last = F.least(F.col(high), F.col("first_pos") + F.size("ts")) - 1

        def step(pos: Column) -> Column:
            at = pos - F.col("first_pos")
            values = [F.get(c, at).alias(c) for c in ("ts", *VALUES)]
            return F.struct((pos - F.col(low) + before).cast("int").alias("blow_pos"), F.lit(name).alias("part"), *values)

        return F.when(first <= last, F.transform(F.sequence(first, last), step)).otherwise(F.array().cast(STEP))

    width = F.col("d_hi") - F.col("d_lo")
    return F.concat(part("discharge", "d_lo", "d_hi", F.lit(0)), part("charge", "c_lo", "c_hi", width))


def _in_chunk() -> Column:
    """Whether the chunk holds a step of either part, told from positions alone."""
    after = F.col("first_pos") + F.size("ts")
    parts = [F.greatest(F.col(low), F.col("first_pos")) < F.least(F.col(high), after) for low, high in (("d_lo", "d_hi"), ("c_lo", "c_hi"))]
    return parts[0] | parts[1]


def blow_steps(real: DataFrame, traces: DataFrame, p: Params) -> DataFrame:
    """Synthetic blows ``(soc, thing, month_idx, ep_idx, steps)`` of full width, steps in order.

    A blow takes the trace's rows at the times of the real blow. Where no time occurs again in the thing, those are the
    rows at the same positions, found in the chunk. Episodes with a time that does are looked up by time, over all traces
    of their things, as repeated times add rows and so drop the blow.
    """
    again = small(repeated_episodes(real))
    # Chunks without a step go by their positions: a filter on the steps would be pushed down and cut them a second time.
    plain = overlay(with_windows(real.join(again, EPISODE, "left_anti"), p).where(_in_chunk()), traces)
    pieces = plain.select(*SAMPLE, _steps_in_chunk().alias("steps"))
    found = pieces.groupBy(*SAMPLE).agg(F.sort_array(F.flatten(F.collect_list("steps"))).alias("steps"))
    found = found.where(F.size("steps") == p.blow_rows)
    if again.isEmpty():
        return found
    things = small(again.select("thing").distinct())
    pooled = rows_of(overlay(real.join(things, "thing", "left_semi"), traces).drop(*STATS), ["ts", *VALUES])
    rows = rows_of(real.join(again, EPISODE, "left_semi").drop(*STATS), ["ts", *VALUES])
    looked_up = synthetic_blows(extract_blows(rows, p, one_pass=False), pooled, p.blow_rows)
    step = F.struct("blow_pos", "part", "ts", *VALUES)
    return found.unionByName(looked_up.groupBy(*SAMPLE).agg(F.sort_array(F.collect_list(step)).cast(STEP).alias("steps")))


def gather(rows: DataFrame) -> DataFrame:
    """Blow rows ``(soc, thing, month_idx, ep_idx, part, blow_pos, ts, current, voltage)`` as one row per blow."""
    step = F.struct("blow_pos", "part", "ts", *VALUES)
    return rows.groupBy(*SAMPLE).agg(F.sort_array(F.collect_list(step)).alias("steps"))


def blow_rows(steps: DataFrame) -> DataFrame:
    """Blows as rows, with ``part`` and ``blow_pos``."""
    return steps.select(*SAMPLE, F.inline("steps"))


def _scaled(value: Column, column: str) -> Column:
    lo, hi = F.col(f"{column}_lo"), F.col(f"{column}_hi")
    return (value - lo) * 2 / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo) - 1


def sample_arrays(steps: DataFrame, bounds: DataFrame, name: str = "x") -> DataFrame:
    """One scaled array per blow: current and voltage of each step in turn. ``bounds`` is a single row."""
    pairs = F.transform("steps", lambda s: F.array(*[_scaled(s[c], c) for c in VALUES]))
    return steps.join(F.broadcast(bounds)).select(*SAMPLE, F.flatten(pairs).alias(name))


def fit_bounds(steps: DataFrame) -> DataFrame:
    """One row with the lowest and highest current and voltage over all steps, widened by the sentinels."""
    folds = {"lo": (F.array_min, F.min, F.least), "hi": (F.array_max, F.max, F.greatest)}
    wanted = [
        whole(total(inside(F.col("steps")[c])), *[F.lit(v) for v in SENTINELS[c]]).alias(f"{c}_{end}")
        for end, (inside, total, whole) in folds.items()
        for c in VALUES
    ]
    return steps.agg(*wanted)


def health_pairs(blows: DataFrame, values: str = "steps", full: int = 100) -> DataFrame:
    """Each blow of a health level beside the same blow at full health: ``soc, thing, month_idx, ep_idx, <values>, full``.

    The levels of an episode, a handful of rows, meet in one aggregate. Blows with a null key pair with nothing.
    """
    held = blows.dropna(subset=EPISODE).groupBy(*EPISODE).agg(F.collect_list(F.struct("soc", values)).alias("levels"))
    whole = F.get(F.filter("levels", lambda level: level["soc"] == full), F.lit(0))[values].alias("full")
    lower = F.explode(F.filter("levels", lambda level: level["soc"] != full)).alias("level")
    paired = held.select(*EPISODE, whole, lower).where(F.col("full").isNotNull())
    return paired.select("level.soc", *EPISODE, f"level.{values}", "full")


def voltage_differences(blows: DataFrame) -> DataFrame:
    """Voltage at full health minus voltage at each lower level, step by step: ``soc, thing, month_idx, ep_idx, difference``."""
    paired = health_pairs(blows.select(*SAMPLE, F.col("steps")["voltage"].alias("voltage")), "voltage")
    return paired.select(*SAMPLE, F.explode(F.zip_with("full", "voltage", lambda f, v: f - v)).alias("difference"))


def blow_mae(steps: DataFrame, bounds: DataFrame, full: int = 100) -> DataFrame:
    """Scaled mean absolute error of each blow against the same blow at full health, steps paired in place."""
    paired = health_pairs(sample_arrays(steps, bounds), "x", full)
    total = F.aggregate(F.zip_with("x", "full", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, g: s + g)
    return paired.select(*EPISODE, "soc", (total / F.size("full")).alias("mae"))
