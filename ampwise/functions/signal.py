"""Row predicates and time functions of the telemetry signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampwise.schema import Params


def is_discharge(p: Params, current: str = "current") -> Column:
    return F.col(current) <= p.discharge


def is_charge(p: Params, current: str = "current") -> Column:
    return F.col(current) >= p.charge


def is_rest(p: Params, current: str = "current") -> Column:
    """Rest shares its closed bounds with the other two states: a current of exactly +-10 is in both."""
    return F.col(current).between(-p.rest, p.rest)


def past_discharge(p: Params, current: str = "current") -> Column:
    """The strict end-of-discharge test."""
    return F.col(current) > p.discharge


def whole_seconds(later_us: Column, earlier_us: Column) -> Column:
    """Elapsed whole seconds between two microsecond clocks, never negative in use."""
    return F.floor((later_us - earlier_us) / F.lit(1_000_000))


def parse_timestamp(text: Column) -> Column:
    """Null, not an error, for text that is no timestamp; the null drop removes such rows."""
    return F.try_to_timestamp(text)


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
