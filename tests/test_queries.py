"""Registered queries against their check SQL. AMPWISE_ALL_QUERIES=1 runs every one of them."""

import os

import compare
import pytest

import __spark_entry__ as entry_module
from ampwise.plans.catalog import CHECKS, QUERIES

QUICK = [
    "telemetry_clean",
    "status_lines_twos",
    "candidates_over_months",
    "candidates_clean_discharge",
    "episode_summary",
    "blow_pairs",
    "blow_mae",
    "simulation_parameters",
    "mixed_age_things",
    "fold_map_customers",
    "threshold_sweep",
    "map_report",
    "vector_losses",
    "faulty_files",
    "repeated_times",
    "stored_rates",
]
CHOSEN = sorted(QUERIES) if os.environ.get("AMPWISE_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def connection(small_folder):
    return compare.connect(small_folder)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, small_folder, connection, name):
    df = QUERIES[name](spark, small_folder)
    if name in CHECKS:
        assert compare.difference(df, connection, CHECKS[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    rows = entry_module.entry(spark).collect()
    totals = {status: sum(r[status] for r in rows) for status in ("valid", "inconsistent", "incomplete", "noise", "context")}
    assert totals["valid"] == 7 and sum(totals.values()) == 359
