"""Series stores: chunks meet bucket by bucket and give what the row forms give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ampwise.operators import align, blows, scaling, steps
from ampwise.schema import EPISODE, Params
from ampwise.sources import series

P = Params(2, 2, 3, 3)
T0 = dt.datetime(2024, 3, 1)


def signal(r, rows):
    """Rest, discharge and charge stretches, the first two long, so that blows lie in different chunks."""
    out, state = [], 0
    while len(out) < rows:
        out += [(0.0, -20.0, 20.0)[state % 3]] * r.randint(2, 7 if rows < 100 else 400)
        state += 1
    return out[:rows]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(9)
    data, clock = [], {}
    for thing in ("a", "b", "c"):
        for month in (0, 1):
            for ep in range(4):
                size = r.choice([1, 5, 30, 40, 900, 1500])
                begin = clock.get(thing, 0)
                again = r.random() < 0.3  # times come in pairs, or the episode begins before the last one ends
                begin -= 3 if again and ep else 0
                for pos, current in enumerate(signal(r, size)):
                    second = begin + (pos // 2 * 2 if again and ep % 2 else pos)
                    data.append((thing, month, ep, pos, T0 + dt.timedelta(seconds=second), current, 20 + pos % 17 / 4))
                clock[thing] = begin + size
            clock[thing] += 40 * 86400
    schema = "thing string, month_idx int, ep_idx int, pos int, ts timestamp, current double, voltage double"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="module")
def traces(rows):
    leveled = rows.withColumn("soc", F.explode(F.array(F.lit(100), F.lit(90))))
    return leveled.select(
        "thing", "soc", (F.col("month_idx") + 1).alias("month_no"), (F.col("ep_idx") + 1).alias("ep_no"), "pos",
        (F.col("current") + 0.5).alias("current"), (F.col("voltage") * F.col("soc") / 100).alias("voltage"),
    )


@pytest.fixture(scope="module")
def stores(spark, rows, traces, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("series"))
    real = series.save(series.episode_series(rows, P, one_pass=False), f"{root}/episodes", 5)
    return real, series.save(series.trace_series(traces), f"{root}/traces", 5), root


def bag(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_overlay_equals_the_row_form_without_a_shuffle(spark, rows, traces, stores):
    real, laid, _ = stores
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = steps.overlay(real, laid)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    columns = ["soc", *EPISODE, "pos", "ts", "current", "voltage"]
    want = align.overlay(rows, traces).select(*columns)
    assert bag(series.rows_of(found, ["ts", "current", "voltage"]).select(*columns)) == bag(want)
    assert real.agg(F.max(F.size("ts"))).first()[0] == series.CHUNK_ROWS


def test_blows_equal_the_row_form(rows, traces, stores):
    real, laid, _ = stores
    columns = ["soc", *EPISODE, "part", "blow_pos", "ts", "current", "voltage"]
    want = align.synthetic_blows(blows.extract_blows(rows, P, one_pass=False), align.overlay(rows, traces), P.blow_rows)
    found = steps.blow_steps(real, laid, P)
    assert bag(steps.blow_rows(found).select(*columns)) == bag(want.select(*columns)) and want.count() > 0
    again = {tuple(r) for r in series.repeated_episodes(real).collect()}
    assert again and len(again) < rows.select(*EPISODE).distinct().count()
    repeated = rows.groupBy("thing", "ts").count().where("count > 1").drop("count")
    truly = {tuple(r) for r in rows.join(repeated, ["thing", "ts"]).select(*EPISODE).distinct().collect()}
    assert truly <= again
    bounds = scaling.fit_bounds(want.where("soc = 100"))
    assert bag(steps.fit_bounds(found.where("soc = 100"))) == bag(bounds)
    errors = {tuple(r)[:4]: r.mae for r in steps.blow_mae(found, bounds).select(*EPISODE, "soc", "mae").collect()}
    plain = {tuple(r)[:4]: r.mae for r in align.blow_mae(want, bounds).select(*EPISODE, "soc", "mae").collect()}
    assert errors.keys() == plain.keys() and all(errors[k] == pytest.approx(plain[k]) for k in plain)
    columns = ["soc", *EPISODE]
    gaps = steps.voltage_differences(found).groupBy(*columns).agg(F.round(F.sum("difference"), 9).alias("d"), F.count("*").alias("n"))
    plain = align.voltage_differences(want, (90,)).groupBy(*columns).agg(F.round(F.sum("difference"), 9).alias("d"), F.count("*").alias("n"))
    assert bag(gaps) == bag(plain)


def test_steps_are_cut_once(stores):
    """No filter repeats the cutting of steps, and chunks without a step are left out before they meet traces."""
    real, laid, _ = stores
    plan = steps.blow_steps(real, laid, P)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert "lambdafunction" in plan and not any("lambdafunction" in line for line in filters)
    assert any("d_lo" in line or "first_pos" in line for line in filters)


def test_length_errors_equal_the_row_form(rows, traces, stores, tmp_path):
    real, _, _ = stores
    damaged = traces.where(~((F.col("ep_no") == 2) & (F.col("soc") == 90)) & ~((F.col("ep_no") == 1) & (F.col("pos") > 600)))
    laid = series.save(series.trace_series(damaged), str(tmp_path / "damaged"), 5)
    columns = ["soc", *EPISODE, "real_rows", "trace_rows"]
    want = align.length_errors(rows, damaged).select(*columns)
    assert bag(steps.length_errors(real, laid).select(*columns)) == bag(want) and want.count() > 0


def test_a_store_is_registered_again(spark, stores):
    real, _, root = stores
    path = f"{root}/episodes"
    before = bag(real.select(*series.SERIES))
    spark.sql(f"DROP TABLE {series._table_name(path)}")  # another session does not know it; the data stay
    loaded = series.load(spark, path)
    assert bag(loaded.select(*series.SERIES)) == before
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {series._table_name(path)}").collect()}
    assert described["Num Buckets"] == "5"
