"""Column names, types and the episode parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# The sensor file layout, in file order. Two text columns, then sixteen 32-bit measures.
FILE_COLUMNS = [
    "TSTAMP",
    "THING",
    "CONF",
    "SPEED",
    "S_IBATCB1_CB1",
    "S_IBATCB2_CB2",
    "S_IOUTBUR1_BUR1",
    "S_IOUTBUR2_BUR2",
    "S_ITOTCB1_CB1",
    "S_ITOTCB2_CB2",
    "S_TBATCB1_CB1",
    "S_TBATCB2_CB2",
    "S_VBATCB1_CB1",
    "S_VBATCB2_CB2",
    "S_VINCB1_CB1",
    "S_VINCB2_CB2",
    "S_CORRBATT_FLG1",
    "S_TENSBATT_FLG1",
]
MEASURES = FILE_COLUMNS[2:]
CURRENT_FIELD = "S_CORRBATT_FLG1"
VOLTAGE_FIELD = "S_TENSBATT_FLG1"

RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in FILE_COLUMNS[:2]]
    + [T.StructField(name, T.FloatType()) for name in MEASURES]
)

# Keys used throughout the library.
MONTH = ["thing", "year", "month"]
EPISODE = ["thing", "month_idx", "ep_idx"]
ORDER = ["ts", "seq"]


@dataclass(frozen=True)
class Params:
    """Row counts and thresholds that define an episode.

    ``eps1``/``eps2``: rest rows before the start and at the end; ``alpha1``/``alpha2``: minimum discharge and
    charge rows. ``gap_s``: a discharge row opens a run when the previous one is more than this many whole
    seconds back. ``period_s``: nominal seconds per row, for the consistency check.
    """

    eps1: int = 10
    eps2: int = 10
    alpha1: int = 15
    alpha2: int = 15
    gap_s: int = 1
    period_s: int = 1
    discharge: float = -10.0
    charge: float = 10.0
    rest: float = 10.0

    def __post_init__(self) -> None:
        for name in ("eps1", "eps2", "alpha1", "alpha2", "period_s"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @property
    def blow_rows(self) -> int:
        """Rows of a complete joined blow."""
        return self.eps1 + self.alpha1 + self.alpha1 + self.alpha2

    @property
    def suffix(self) -> str:
        return f"{self.eps1}_{self.eps2}_{self.alpha1}_{self.alpha2}"

    def with_clock(self, gap_s: int, period_s: int) -> "Params":
        return replace(self, gap_s=gap_s, period_s=period_s)


# The setting every entry point uses.
FIVES = Params(5, 5, 5, 5)
