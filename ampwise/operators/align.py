"""Line up measured episodes with simulated traces of other health levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampwise.functions.numeric import aged_parameters, bind, uniform
from ampwise.operators.blows import drop_odd_widths
from ampwise.operators.scaling import scale
from ampwise.schema import EPISODE

BLOW = [*EPISODE, "part", "blow_pos"]


def _zero_based(trace: DataFrame) -> DataFrame:
    return trace.withColumns(
        {"month_idx": F.col("month_no") - 1, "ep_idx": F.col("ep_no") - 1}
    ).drop("month_no", "ep_no")


def overlay(real: DataFrame, trace: DataFrame, voltage_only: bool = False) -> DataFrame:
    """Replace current and voltage of the real rows by the trace at the same position.

    Run ``length_errors`` first: a trace of another length is an input error, which an inner join would hide.
    """
    replaced = ["voltage"] if voltage_only else ["current", "voltage"]
    values = _zero_based(trace).select(*EPISODE, "pos", "soc", *replaced)
    kept = [c for c in real.columns if c not in replaced]
    return real.select(*kept).join(values, [*EPISODE, "pos"])


def length_errors(real: DataFrame, trace: DataFrame) -> DataFrame:
    """Episodes whose trace is missing or of another length, and traces without an episode."""
    expected = real.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("real_rows"))
    found = _zero_based(trace).groupBy("soc", *EPISODE).agg(F.count(F.lit(1)).alias("trace_rows"))
    levels = found.select("thing", "soc").distinct()
    due = expected.join(levels, "thing")
    both = due.join(found, ["soc", *EPISODE], "full_outer")
    return both.where(~F.col("real_rows").eqNullSafe(F.col("trace_rows")))


def synthetic_blows(blows: DataFrame, overlaid: DataFrame, width: int) -> DataFrame:
    """Rows of the overlaid traces at the timestamps of the real blows.

    The lookup pools all traces of a thing, so repeated timestamps add rows; blows of another width are dropped. Traces
    that passed ``length_errors`` cover every timestamp at every level, so an inner join finds what a left join would,
    and each blow row is shuffled once instead of once per level.
    """
    pooled = overlaid.select("thing", "soc", "ts", "current", "voltage")
    looked_up = blows.select(*BLOW, "ts").join(pooled, ["thing", "ts"])
    return drop_odd_widths(looked_up, ["soc", *EPISODE], width)


def health_pairs(rows: DataFrame, keys: Sequence[str], values: Sequence[str], full: int = 100) -> DataFrame:
    """Each row of a health level next to the same key at full health, as ``full_<value>``.

    The levels of a key are gathered in one shuffle and paired inside its row, so the table is neither read nor shuffled
    twice. A key has one row per level. Rows with a null key pair with nothing.
    """
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    held = rows.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_levels"))
    lower = F.explode(F.filter("_levels", lambda row: row["soc"] != full)).alias("_row")
    whole = F.filter("_levels", lambda row: row["soc"] == full).alias("_whole")
    paired = held.select(*keys, whole, lower).select(*keys, "_row.*", F.explode("_whole").alias("_full"))
    return paired.select(*keys, *others, *[F.col(f"_full.{v}").alias(f"full_{v}") for v in values])


def voltage_differences(synthetic: DataFrame, levels: Sequence[int] = tuple(range(50, 100, 5))) -> DataFrame:
    """Voltage at full health minus voltage at each level, row by row."""
    wanted = synthetic.where(F.col("soc").isin(100, *levels)).select(*BLOW, "soc", "voltage")
    paired = health_pairs(wanted, BLOW, ["voltage"])
    return paired.select(*BLOW, "soc", (F.col("full_voltage") - F.col("voltage")).alias("difference"))


def trace_overlay(
    trace: DataFrame, thing: str | None = None, levels: Sequence[int] = (100, 95, 85), every: int = 30
) -> DataFrame:
    """Voltage traces of every n-th episode of one thing (or of each thing), one column per health level."""
    chosen = trace.where(F.col("soc").isin(list(levels)))
    if thing is not None:
        chosen = chosen.where(F.col("thing") == thing)
    keys = ["thing", "month_no", "ep_no"]
    if every > 1:
        # Ranked over the distinct episodes; the trace rows themselves are not windowed.
        along = Window.partitionBy("thing").orderBy("month_no", "ep_no")
        ranked = chosen.select(*keys).distinct().withColumn("_rank", F.row_number().over(along))
        chosen = chosen.join(ranked.where(F.col("_rank") % every == 0).drop("_rank"), keys)
    return (
        chosen.groupBy(*keys, "pos")
        .pivot("soc", list(levels))
        .agg(F.first("voltage"))
        .select(*keys, "pos", *[F.col(str(level)).alias(f"voltage_{level}") for level in levels])
    )


def chosen_health(draw: Column, cuts: Sequence[tuple[float, int]], otherwise: int) -> Column:
    """The health level of the first ``(cut, soc)`` whose cut exceeds the draw, else ``otherwise``."""

    def level(u: Column) -> Column:
        choice = F.lit(otherwise)
        for bound, soc in reversed(list(cuts)):
            choice = F.when(u < bound, F.lit(soc)).otherwise(choice)
        return choice

    return bind(draw, level)


def substitute_degraded(
    rows: DataFrame, cuts: Sequence[tuple[float, int]], seed: int, draw: Column | None = None, full: int = 100
) -> DataFrame:
    """Keep each episode at exactly one health level, drawn per episode.

    The levels of an episode sit in the same table, so picking one is a filter on its key, not a join. An episode that
    lacks its drawn level is dropped here, as there is nothing to put in its place.
    """
    draw = uniform(*[F.col(c) for c in EPISODE], seed=seed) if draw is None else draw
    return rows.where(F.col("soc") == chosen_health(draw, cuts, full))


def blow_mae(synthetic: DataFrame, bounds: DataFrame, full: int = 100) -> DataFrame:
    """Scaled mean absolute error of each blow against the same blow at full health."""
    scaled = scale(synthetic, bounds, ["current", "voltage"])
    paired = health_pairs(scaled.select(*BLOW, "soc", "current", "voltage"), BLOW, ["current", "voltage"], full)
    error = F.abs(F.col("current") - F.col("full_current")) + F.abs(F.col("voltage") - F.col("full_voltage"))
    return paired.groupBy(*EPISODE, "soc").agg((F.sum(error) / (2 * F.count(F.lit(1)))).alias("mae"))


def simulation_work(episode_rows_count: DataFrame, levels: Sequence[int]) -> DataFrame:
    """One simulator run per episode and health level: aged battery parameters and stop time."""
    per_level = episode_rows_count.withColumn("soc", F.explode(F.array(*[F.lit(level) for level in levels])))
    stop = [(F.col("rows") - 1).alias("stop_time")] if "rows" in episode_rows_count.columns else []
    kept = [c for c in per_level.columns if c != "rows"]
    return per_level.select(
        *kept, *stop, *[c.alias(name) for name, c in aged_parameters(F.col("soc")).items()]
    )
