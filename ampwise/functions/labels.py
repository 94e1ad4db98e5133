"""Names and labels built from keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capacity at full health, and the formats of stored names.
NOMINAL_CAPACITY = 340
MODEL_FORMAT = "Enc_%d_Synthetic_%d_%s_K_%d"
MAP_FORMAT = "map_model_%s_th_%d"
EPISODE_FILE_FORMAT = "%d_%d.csv"
HEALTH_FORMAT = "SOH %d"


def model_name(code_size: Column, kind: Column, k: Column, soc: int = 100) -> Column:
    return F.format_string(MODEL_FORMAT, code_size, F.lit(soc), kind, k)


def map_name(model: Column, percentile: int) -> Column:
    return F.format_string(MAP_FORMAT, model, F.lit(percentile))


def episode_file(month_no: Column, ep_no: Column) -> Column:
    return F.format_string(EPISODE_FILE_FORMAT, month_no, ep_no)


def health_label(soc: Column) -> Column:
    return F.format_string(HEALTH_FORMAT, soc)


def capacity_label(position: Column) -> Column:
    """Remaining capacity of the health level at 0-based ``position`` in 100, 95, 90, ..."""
    return F.floor(F.lit(NOMINAL_CAPACITY) * (F.lit(100) - 5 * position) / 100).cast("int")


def folder_stem(name: Column) -> Column:
    """Drop one extension; a leading dot is not one."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def folder_thing(name: Column) -> Column:
    """First token of the name without its first character."""
    return F.regexp_extract(folder_stem(name), "^.([^_]*)", 1)


def folder_soc(name: Column) -> Column:
    return F.get(F.split(folder_stem(name), "_"), F.lit(1)).try_cast("int")
