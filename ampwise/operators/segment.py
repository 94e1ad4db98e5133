"""Cut each thing's monthly signal into episode candidates with a status.

Rows are shuffled once on (thing, year, month). One window pass flags the few rows that can open or close an
episode (*marks*); everything after works on marks. A month too large for one task is windowed in pieces: every
piece sees the rows around it that bounded frames need, and unbounded frames add what earlier pieces carry over.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampwise.functions.signal import (
    count_where,
    is_charge,
    is_discharge,
    is_rest,
    past_discharge,
    whole_seconds,
)
from ampwise.operators.ordering import MAX_GROUP_ROWS, dealt_in_pieces, earlier_pieces, find_hot
from ampwise.schema import MONTH, Params
from ampwise.session import small, stage

log = logging.getLogger(__name__)

SWAB_TO_SWAB = "swab2swab"
CLEAN_DISCHARGE = "swabCleanDischarge"
STATUSES = ["valid", "inconsistent", "incomplete", "noise", "context"]

CUT_COLUMNS = [
    *MONTH,
    "start_rn",
    "next_rn",
    "end_rn",
    "status",
    "start_us",
    "from_us",
    "from_seq",
    "to_us",
    "to_seq",
]


def resolve_mode(mode: str) -> str:
    if mode not in (SWAB_TO_SWAB, CLEAN_DISCHARGE):
        log.warning("%s is not an episode mode, %s is used", mode, SWAB_TO_SWAB)
        return SWAB_TO_SWAB
    return mode


def dated(telemetry: DataFrame) -> DataFrame:
    """Only what segmentation needs, with the month key and a microsecond clock."""
    return telemetry.select(
        "thing",
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.unix_micros("ts").alias("us"),
        "seq",
        "current",
    )


def months(telemetry: DataFrame) -> DataFrame:
    """Month ordinal per thing, among the months with any row."""
    present = telemetry.select("thing", F.year("ts").alias("year"), F.month("ts").alias("month")).distinct()
    calendar = Window.partitionBy("thing").orderBy("year", "month")
    return present.withColumn("month_idx", F.row_number().over(calendar) - 1)


def _frames(rows: DataFrame, p: Params, mode: str, keys: list[str]) -> DataFrame:
    """All row-level windows; one sort, one pass."""
    order = Window.partitionBy(*keys).orderBy("us", "seq")

    def span(first: int, last: int):
        return order.rowsBetween(first, last)

    before = order.rowsBetween(Window.unboundedPreceding, -1)
    dis, chg, rest = is_discharge(p), is_charge(p), is_rest(p)
    common = [
        F.row_number().over(order).alias("rn"),
        F.max(F.when(dis, F.col("us"))).over(before).alias("prev_dis"),
        count_where(rest).over(span(-p.eps1, -1)).alias("rest_before"),
        count_where(dis).over(span(0, p.alpha1 - 1)).alias("dis_ahead"),
        F.lag("us", p.eps1).over(order).alias("from_us"),
        F.lag("seq", p.eps1).over(order).alias("from_seq"),
    ]
    if mode == SWAB_TO_SWAB:
        own = [
            count_where(chg).over(before).alias("chg_before"),
            count_where(chg).over(span(0, p.alpha1 - 1)).alias("chg_skip"),
            count_where(rest).over(span(0, p.eps2 - 1)).alias("rest_ahead"),
            F.lag(rest & ~chg, 1).over(order).alias("prev_only_rest"),
            F.lag(dis, p.alpha1 + 1).over(order).alias("dis_at_seek"),
            F.lead("us", p.eps2).over(order).alias("to_us"),
            F.lead("seq", p.eps2).over(order).alias("to_seq"),
        ]
    else:
        own = [
            F.lag(dis, 1).over(order).alias("prev_is_dis"),
            F.col("us").alias("to_us"),
            F.col("seq").alias("to_seq"),
        ]
    return rows.select("*", *common, *own)


def _flags(framed: DataFrame, p: Params, mode: str) -> DataFrame:
    """Reduce rows to marks: starts, possible ends, and the first row of a month.

    In the default mode the earliest row satisfying an end condition always follows a row that does not. Given enough
    rest from here on, that leaves rows whose predecessor is not rest or is a charge row, and the first row past the
    seek offset.
    """
    gap = whole_seconds(F.col("us"), F.col("prev_dis"))
    is_start = is_discharge(p) & F.col("prev_dis").isNotNull() & (gap > p.gap_s)
    if mode == SWAB_TO_SWAB:
        first = ~F.coalesce(F.col("prev_only_rest"), F.lit(False)) | F.coalesce(F.col("dis_at_seek"), F.lit(False))
        is_end = (F.col("rest_ahead") == p.eps2) & first
        charged = F.col("chg_before")
        charged_at_seek = F.col("chg_before") + F.col("chg_skip")
    else:
        is_end = past_discharge(p) & F.coalesce(F.col("prev_is_dis"), F.lit(False))
        charged = charged_at_seek = F.lit(0).cast("long")
    piece = [c for c in ("_piece", "_hot") if c in framed.columns]
    return framed.select(
        *MONTH,
        *piece,
        "us",
        "seq",
        "rn",
        F.coalesce(is_start, F.lit(False)).alias("is_start"),
        is_end.alias("is_end"),
        (F.col("rest_before") == p.eps1).alias("rested"),
        (F.col("dis_ahead") == p.alpha1).alias("discharged"),
        charged.alias("charged"),
        charged_at_seek.alias("charged_at_seek"),
        "from_us",
        "from_seq",
        "to_us",
        "to_seq",
    ).where(F.col("is_start") | F.col("is_end"))


def _neighbours(rows: DataFrame, p: Params) -> DataFrame:
    """Copies of the rows next to each piece border, addressed to the piece on the other side.

    Every piece holds at least one row, so the nearest ``reach`` rows on one side of a border lie in the nearest
    ``reach`` pieces. Size: pieces x reach rows.
    """
    reach = max(p.eps1, p.alpha1 + 1, p.eps2) + 1
    hot = rows.where("_hot")
    inside = [*MONTH, "_piece"]

    def border(descending: bool) -> DataFrame:
        order = [F.desc("us"), F.desc("seq")] if descending else [F.asc("us"), F.asc("seq")]
        edge = hot.withColumn("_edge", F.row_number().over(Window.partitionBy(*inside).orderBy(*order)))
        edge = edge.where(F.col("_edge") <= reach).drop("_edge")
        if descending:
            target = F.sequence(F.col("_piece") + 1, F.col("_piece") + reach)
        else:
            target = F.sequence(F.col("_piece") - reach, F.col("_piece") - 1)
        addressed = edge.withColumn("_piece", F.explode(target))
        nearest = F.row_number().over(Window.partitionBy(*inside).orderBy(*order))
        return addressed.withColumn("_near", nearest).where(F.col("_near") <= reach).drop("_near")

    present = hot.select(*inside).distinct()
    return border(True).unionByName(border(False)).join(small(present), inside, "left_semi")


def _marks_in_pieces(rows: DataFrame, p: Params, mode: str, hot: DataFrame) -> DataFrame:
    split = dealt_in_pieces(rows, MONTH, ["us", "seq"], hot)
    own = split.withColumn("_own", F.lit(True))
    borders = _neighbours(split, p).withColumn("_own", F.lit(False))
    framed = _frames(own.unionByName(borders), p, mode, [*MONTH, "_piece"])
    # Frames that reach back without bound must count own rows only; the rest comes from the carry.
    order = Window.partitionBy(*MONTH, "_piece").orderBy("us", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    framed = framed.withColumn("rn", count_where(F.col("_own")).over(before) + 1)
    framed = framed.withColumn(
        "prev_dis", F.max(F.when(is_discharge(p) & F.col("_own"), F.col("us"))).over(before)
    )
    if mode == SWAB_TO_SWAB:
        framed = framed.withColumn("chg_before", count_where(is_charge(p) & F.col("_own")).over(before))
    framed = framed.where("_own")
    counts = earlier_pieces(
        split, MONTH, {"_rows": F.count(F.lit(1)), "_chg": count_where(is_charge(p))}
    )
    latest = earlier_pieces(
        split, MONTH, {"_dis": F.max(F.when(is_discharge(p), F.col("us")))}, fold="max"
    )
    inside = [*MONTH, "_piece"]
    framed = framed.join(small(counts), inside, "left").join(small(latest), inside, "left")
    framed = framed.withColumn("rn", F.col("rn") + F.coalesce("_rows", F.lit(0)))
    framed = framed.withColumn("prev_dis", F.greatest("prev_dis", "_dis"))
    if mode == SWAB_TO_SWAB:
        framed = framed.withColumn("chg_before", F.col("chg_before") + F.coalesce("_chg", F.lit(0)))
    return stage(_flags(framed.drop("_rows", "_chg", "_dis", "_own"), p, mode))


def _owners(marks: DataFrame, in_pieces: bool) -> DataFrame:
    """Per mark, the last start strictly before it: a start closes the previous segment, so it belongs there."""
    keys = [*MONTH, "_piece"] if in_pieces else MONTH
    before = Window.partitionBy(*keys).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    started = F.when(F.col("is_start"), F.struct("rn", "charged_at_seek"))
    owned = marks.withColumn("owner", F.max(started).over(before))
    if in_pieces:
        carried = earlier_pieces(marks, MONTH, {"_owner": F.max(started)}, fold="max")
        owned = owned.join(small(carried), keys, "left")
        owned = owned.withColumn("owner", F.coalesce("owner", "_owner")).drop("_owner")
    return owned


def _segments(owned: DataFrame, p: Params, mode: str, in_pieces: bool) -> DataFrame:
    """One row per start with its earliest end. Starts and ends meet in one aggregation, not in a join."""
    keys = [*MONTH, "_piece", "_hot"] if in_pieces else MONTH
    skip = p.alpha1 if mode == SWAB_TO_SWAB else 0
    charge = p.alpha2 if mode == SWAB_TO_SWAB else 0
    closes = (
        F.col("is_end")
        & (F.col("rn") > F.col("owner.rn") + skip)
        & (F.col("charged") - F.col("owner.charged_at_seek") >= charge)
    )
    start_fields = ["us", "rested", "discharged", "from_us", "from_seq", "seq"]
    if in_pieces:
        start_fields += ["_piece", "_hot"]
    start = F.struct(*start_fields)
    end = F.struct("rn", "to_us", "to_seq")
    as_start = F.when(
        F.col("is_start"), F.struct(F.col("rn").alias("seg"), start.alias("start"), F.lit(None).alias("end"))
    )
    as_end = F.when(
        closes, F.struct(F.col("owner.rn").alias("seg"), F.lit(None).alias("start"), end.alias("end"))
    )
    roles = F.filter(F.array(as_start, as_end), lambda role: role.isNotNull())
    return (
        owned.select(*MONTH, F.inline(roles))
        .groupBy(*MONTH, "seg")
        .agg(F.max("start").alias("start"), F.min("end").alias("end"))
        .select(*MONTH, F.col("seg").alias("start_rn"), "start.*", "end")
    )


def _with_next(segments: DataFrame, in_pieces: bool) -> DataFrame:
    keys = [*MONTH, "_piece"] if in_pieces else MONTH
    along = Window.partitionBy(*keys).orderBy("start_rn")
    following = F.struct("start_rn", "us", "seq")
    nexted = segments.withColumn("next", F.lead(following).over(along))
    if in_pieces:
        carried = earlier_pieces(segments, MONTH, {"_next": F.min(following)}, fold="min", later=True)
        nexted = nexted.join(small(carried), keys, "left")
        nexted = nexted.withColumn("next", F.coalesce("next", "_next")).drop("_next")
    return nexted.where(F.col("next").isNotNull())


def _judge(candidates: DataFrame, p: Params, mode: str) -> DataFrame:
    """First failing rule names the status; missing ends are tested before they are compared."""
    rows = F.col("next.start_rn") - F.col("start_rn")
    if mode == SWAB_TO_SWAB:
        end_rn, to_us, to_seq = F.col("end.rn") + p.eps2, F.col("end.to_us"), F.col("end.to_seq")
    else:
        end_rn = F.coalesce("end.rn", "next.start_rn")
        to_us = F.coalesce("end.to_us", "next.us")
        to_seq = F.coalesce("end.to_seq", "next.seq")
    status = (
        F.when(~F.col("rested"), "context")
        .when(~F.col("discharged"), "noise")
        .when(end_rn.isNull() | to_us.isNull(), "incomplete")
        .when(whole_seconds(to_us, F.col("from_us")) > rows * p.period_s, "inconsistent")
        .otherwise("valid")
    )
    # Positions are 0-based, ends exclusive.
    judged = candidates.withColumn("status", status)
    ended = F.col("status").isin("valid", "inconsistent")
    return judged.select(
        *MONTH,
        (F.col("start_rn") - 1).alias("start_rn"),
        (F.col("next.start_rn") - 1).alias("next_rn"),
        F.when(ended, end_rn - 1).alias("end_rn"),
        "status",
        F.col("us").alias("start_us"),
        "from_us",
        "from_seq",
        F.when(ended, to_us).alias("to_us"),
        F.when(ended, to_seq).alias("to_seq"),
        *[c for c in ("_piece", "_hot") if c in candidates.columns],
    )


def find_hot_months(telemetry: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame | None:
    return find_hot(dated(telemetry), MONTH, max_rows)


def candidates(
    telemetry: DataFrame,
    p: Params,
    mode: str = SWAB_TO_SWAB,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Every episode candidate with its status and row range.

    ``telemetry``: thing, ts, seq, current, without nulls. ``hot``: the result of ``find_hot_months``; None asserts
    that every month fits one task.
    """
    mode = resolve_mode(mode)
    rows = dated(telemetry)
    in_pieces = hot is not None
    if in_pieces:
        marks = _marks_in_pieces(rows, p, mode, hot)
    else:
        marks = _flags(_frames(rows, p, mode, MONTH), p, mode)
    segments = _segments(_owners(marks, in_pieces), p, mode, in_pieces)
    return _judge(_with_next(segments, in_pieces), p, mode)


def headers(found: DataFrame, month_table: DataFrame, in_pieces: bool = False) -> DataFrame:
    """Valid candidates as episode headers, numbered from 0 inside their month."""
    valid = found.where(F.col("status") == "valid")
    inside = [*MONTH, "_piece"] if in_pieces else MONTH
    number = F.row_number().over(Window.partitionBy(*inside).orderBy("start_rn")) - 1
    numbered = valid.withColumn("ep_idx", number)
    if in_pieces:
        carried = earlier_pieces(valid, MONTH, {"_earlier": F.count(F.lit(1))})
        numbered = numbered.join(small(carried), inside, "left")
        numbered = numbered.withColumn("ep_idx", F.col("ep_idx") + F.coalesce("_earlier", F.lit(0))).drop(
            "_earlier", "_piece", "_hot"
        )
    return numbered.join(month_table, MONTH).withColumn("ep_idx", F.col("ep_idx").cast("int"))


def status_totals(found: DataFrame, by: Column | str = "thing") -> DataFrame:
    """Valid and rejected candidates per thing, one column per status."""
    return (
        found.groupBy(by)
        .pivot("status", STATUSES)
        .agg(F.count(F.lit(1)))
        .na.fill(0, STATUSES)
    )
