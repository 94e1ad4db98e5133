import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ampwise.functions import numeric
from ampwise.operators import align, folds, metrics, reconstruct, scaling
from ampwise.operators.ordering import find_hot, ordinal, running
from ampwise.operators.quantiles import percentiles


def skewed(spark, rows=900):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 40}", round(rng.uniform(0, 50), 1), i, i % 2) for i in range(rows)]
    return spark.createDataFrame(data, "k string, v double, id int, one int")


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_agree_when_split(spark, descending):
    df = skewed(spark)
    hot = find_hot(df, ["k"], max_rows=100, pieces=16)
    assert [r.k for r in hot.collect()] == ["hot"]
    sums = {"a": F.col("one"), "b": F.lit(1)}
    whole = running(df, ["k"], "v", ["id"], sums, None, descending)
    split = running(df, ["k"], "v", ["id"], sums, hot, descending)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.select(*whole.columns).collect()))


def test_ordinals_agree_when_split(spark):
    df = skewed(spark)
    hot = find_hot(df, ["k"], max_rows=100, pieces=16)
    whole = ordinal(df, ["k"], "v", ["id"], "n", None, start=1)
    split = ordinal(df, ["k"], "v", ["id"], "n", hot, start=1)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.select(*whole.columns).collect()))


def test_every_large_group_is_split_by_its_size(spark):
    df = spark.range(2000).select((F.col("id") % 400).alias("k"), F.col("id").alias("v"))
    hot = find_hot(df, ["k"], max_rows=4)
    assert hot.count() == 400 and hot.where("_pieces = 2").count() == 400
    assert find_hot(df, ["k"], max_rows=5) is None
    whole = ordinal(df, ["k"], "v", [], "n", None)
    assert sorted(map(tuple, ordinal(df, ["k"], "v", [], "n", hot).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    huge = spark.range(6000).select(F.when(F.col("id") < 5000, 0).otherwise(1).alias("k"), F.col("id").alias("v"))
    assert {r.k: r._pieces for r in find_hot(huge, ["k"], max_rows=10).collect()} == {0: 500, 1: 100}


def test_a_dominant_value_is_split_by_the_tie_break(spark):
    df = spark.range(6000).select(
        (F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 7 * 1.0).alias("v"), F.format_string("s%05d", "id").alias("id")
    )
    hot = find_hot(df, ["k"], max_rows=500)
    sums = {"total": F.lit(1)}
    for descending in (False, True):
        whole = running(df, ["k"], "v", ["id"], sums, None, descending)
        split = running(df, ["k"], "v", ["id"], sums, hot, descending)
        assert sorted(map(tuple, split.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    ranges = df.repartitionByRange(12, "k", "v", "id").groupBy(F.spark_partition_id()).count()
    assert ranges.agg(F.max("count")).first()[0] < 2000  # the dominant value alone has 2000 rows a group
    fractions = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    exact = percentiles(df, ["k"], "v", fractions, hot=None)
    ranked = percentiles(df, ["k"], "v", fractions, max_rows=500)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, exact.collect()))


def test_one_dominant_value(spark):
    df = spark.range(3000).select(F.lit("m").alias("k"), F.when(F.col("id") % 5 > 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"), "id")
    hot = find_hot(df, ["k"], max_rows=100)
    whole = ordinal(df, ["k"], "v", ["id"], "n", None)
    assert sorted(map(tuple, ordinal(df, ["k"], "v", ["id"], "n", hot).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_sizes_above_the_basis_are_refused(spark):
    samples = spark.createDataFrame([([float(i), 1.0, float(i * i)],) for i in range(9)], "x array<double>")
    model = reconstruct.fit_one(samples, 3)
    with pytest.raises(ValueError, match="code size 4"):
        reconstruct.size_errors(samples, model, [2, 4])


def test_percentiles_match_numpy_on_both_paths(spark):
    df = skewed(spark)
    fractions = [p / 100 for p in range(10, 100)]
    values = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)
    for max_rows in (10_000, 100):
        got = {r.k: list(r["values"]) for r in percentiles(df, ["k"], "v", fractions, max_rows=max_rows).collect()}
        assert set(got) == set(values)
        for k, v in values.items():
            assert np.allclose(got[k], np.percentile(v, range(10, 100)))
    whole = percentiles(df, [], "v", [0.5], max_rows=100).first()["values"][0]
    assert whole == pytest.approx(np.percentile([r.v for r in df.collect()], 50))


@pytest.mark.parametrize("max_rows", [4_000_000, 10])
def test_folds_match_greedy_fill(spark, max_rows):
    rng = random.Random(4)
    for sizes, k in [
        ([rng.randint(0, 9) for _ in range(40)], 6),
        ([100, 1, 1, 1, 1], 3),
        ([1, 1, 1, 1, 100], 3),
        ([3], 4),
    ]:
        df = spark.createDataFrame([(f"t{i}", n, i) for i, n in enumerate(sizes)], "thing string, n long, place int")
        got = {r.thing: r.fold for r in folds.fold_map(df, k, F.col("place"), max_rows=max_rows).collect()}
        assert [got[f"t{i}"] for i in range(len(sizes))] == brute.greedy_folds(sizes, k)


def test_first_thing_may_leave_fold_zero_empty(spark):
    df = spark.createDataFrame([("big", 9, 0), ("b", 1, 1)], "thing string, n long, place int")
    assert {r.thing: r.fold for r in folds.fold_map(df, 3, F.col("place")).collect()} == {"big": 1, "b": 2}


def test_default_fold_order_is_repeatable(spark):
    df = spark.createDataFrame([(f"t{i}", 2) for i in range(30)], "thing string, n long")
    one = sorted(map(tuple, folds.fold_map(df, 6).collect()))
    two = sorted(map(tuple, folds.fold_map(df.repartition(7), 6).collect()))
    assert one == two and {r[-1] for r in one} == set(range(6))


def test_leave_one_out_plan(spark):
    plan = folds.leave_one_fold_out(spark, 3).collect()
    assert {(r.split, r.fold) for r in plan if r.role == "valid"} == {(i, i) for i in range(3)}
    assert len(plan) == 9


def test_scaling_range_and_constant_column(spark):
    df = spark.createDataFrame([(0.0, 20.0, 7.0), (-30.0, 40.0, 7.0)], "current double, voltage double, flat double")
    columns = ["current", "voltage", "flat"]
    bounds = scaling.fit_bounds(df, columns)
    row = bounds.first()
    assert (row.current_lo, row.current_hi, row.voltage_lo, row.voltage_hi) == (-30.0, 0.0, 20.0, 40.0)
    scaled = scaling.scale(df, bounds, columns).collect()
    assert [tuple(r) for r in scaled] == [(1.0, -1.0, -1.0), (-1.0, 1.0, -1.0)]
    narrow = scaling.fit_bounds(spark.createDataFrame([(5.0, 30.0)], "current double, voltage double")).first()
    assert (narrow.current_lo, narrow.current_hi, narrow.voltage_lo, narrow.voltage_hi) == (0.0, 5.0, 22.0, 36.0)


def test_samples_keep_row_order(spark):
    rows = [("a", p, float(p), float(-p)) for p in (2, 0, 1)]
    df = spark.createDataFrame(rows, "k string, blow_pos int, current double, voltage double")
    assert scaling.to_samples(df, ["k"]).first().x == [0.0, 0.0, 1.0, -1.0, 2.0, -2.0]


def test_batches_drop_the_tail(spark):
    df = spark.range(130).select((F.col("id") % 2).alias("g"), "id")
    assert scaling.batch_compatible(df, ["id"], 64).agg(F.max("id")).first()[0] == 127
    grouped = scaling.batch_compatible(df, ["id"], 16, ["g"])
    assert {r.g: r["count"] for r in grouped.groupBy("g").count().collect()} == {0: 64, 1: 64}
    assert scaling.batch_compatible(df.limit(128), ["id"], 64).count() == 128


def scores_table(spark, n=300):
    rng = random.Random(9)
    rows = [
        (f"K_{m}", soc, f"s{i}", round(rng.random() + (100 - soc) / 40, 2))
        for m in (1, 2)
        for i in range(n)
        for soc in metrics.HEALTH_LEVELS
    ]
    return spark.createDataFrame(rows, "model string, soc int, sample_id string, mae double"), rows


def test_sweep_matches_counting(spark):
    df, rows = scores_table(spark)
    limits = spark.createDataFrame(
        [("K_1", 10, 0.5), ("K_1", 11, 0.5), ("K_1", 12, 9.0), ("K_1", 13, -1.0), ("K_2", 10, 0.31)],
        "model string, pct int, threshold double",
    )
    got = {(r.model, r.pct): (r.tp, r.fp, r.tn, r.fn) for r in metrics.confusion(df, limits).collect()}
    for r in limits.collect():
        mine = [(soc < 95, mae >= r.threshold) for m, soc, _, mae in rows if m == r.model]
        want = tuple(mine.count(pair) for pair in ((True, True), (False, True), (False, False), (True, False)))
        assert got[(r.model, r.pct)] == want
    empty = metrics.rates(metrics.confusion(df, limits)).where("pct = 12").first()
    assert empty.precision is None and empty.recall == 0.0 and empty.f is None


def test_curves_agree_when_split(spark):
    df, _ = scores_table(spark)
    flags = metrics.flagged(metrics.mixed_population(df), metrics.percentile_threshold(df, 81)).cache()
    for positive in (True, False):
        whole = metrics.running_curve(flags, positive)
        split = metrics.running_curve(flags, positive, max_rows=20)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))


def test_population_picks_one_level_per_sample(spark):
    df, _ = scores_table(spark, 2000)
    mixed = metrics.mixed_population(df.where("model = 'K_1'"))
    assert mixed.count() == mixed.select("sample_id").distinct().count() == 2000
    share = {r.soc: r["count"] / 2000 for r in mixed.groupBy("soc").count().collect()}
    for soc, want in {80: 0.1, 85: 0.1, 90: 0.1, 95: 0.45, 100: 0.25}.items():
        assert share[soc] == pytest.approx(want, abs=0.04)


def test_precision_divides_by_k_when_short(spark):
    flags = spark.createDataFrame([("m", "a", 2.0, 1), ("m", "b", 1.0, 0)], "model string, sample_id string, mae double, tp int")
    assert metrics.precision_at(flags, 150).first().precision_at_k == pytest.approx(1 / 150)


def test_best_model_and_threshold_ties(spark):
    scores = spark.createDataFrame([("K_2", 1.0), ("K_1", 1.0), ("K_3", 2.0)], "model string, mae double")
    assert metrics.best_model(scores).first().model == "K_1"
    sweep = spark.createDataFrame([("m", 11, 0.5), ("m", 10, 0.5), ("m", 12, None)], "model string, pct int, f double")
    assert metrics.best_threshold(sweep).first().pct == 10


def test_area_under_a_known_curve(spark):
    points = spark.createDataFrame(
        [("m", 12, 0.0, 0.0), ("m", 11, 0.5, 1.0), ("m", 10, 1.0, 1.0)],
        "model string, ordinal int, fpr double, recall double",
    )
    assert metrics.area_under(points).first().auroc == pytest.approx(0.75)


def test_box_fences(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "g int, v double")
    row = metrics.box_stats(df, ["g"], "v", fences=True).first()
    assert (row.low, row.q1, row.q2, row.q3, row.high) == (1.0, 3.0, 5.0, 7.0, 8.0)


def test_losses(spark):
    df = spark.createDataFrame([(0.5,), (-3.0,), (1.0,)], "e double")
    assert [r.h for r in df.select(numeric.huber(F.col("e")).alias("h")).collect()] == [0.125, 2.5, 0.5]
    pair = spark.createDataFrame([([0.5, 0.0], [0.0, 3.0], [1.0, -3.0])], "x array<double>, y array<double>, c array<double>")
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    row = pair.select(numeric.array_mae(x, y), numeric.array_huber(x, y), numeric.sparse_loss(x, y, c)).first()
    assert tuple(row) == (1.75, 1.3125, 3.3125)


def test_simulator_parameters_round_half_away(spark):
    df = spark.createDataFrame([(100,), (75,), (50,)], "soc int")
    rows = df.select("soc", *[c.alias(n) for n, c in numeric.aged_parameters(F.col("soc")).items()]).collect()
    # 386 * 75 / 100 = 289.5; 95 * 50 / 100 = 47.5
    assert [r.max_capacity for r in rows] == [386, 290, 193]
    assert [r.exponential_zone for r in rows] == [95, 71, 48]


def test_length_errors(spark):
    real = spark.createDataFrame([("a", 0, 0, p) for p in range(3)] + [("a", 0, 1, 0)], "thing string, month_idx int, ep_idx int, pos int")
    trace = spark.createDataFrame(
        [("a", 80, 1, 1, p) for p in range(2)] + [("a", 80, 1, 3, 0)],
        "thing string, soc int, month_no int, ep_no int, pos int",
    )
    got = {(r.ep_idx, r.real_rows, r.trace_rows) for r in align.length_errors(real, trace).collect()}
    assert got == {(0, 3, 2), (1, 1, None), (2, None, 1)}


def test_trace_overlay_of_every_nth(spark):
    trace = spark.createDataFrame(
        [(t, s, 1, e, p, float(s + p)) for t in "ab" for s in (100, 95, 85) for e in range(1, 8) for p in range(2)],
        "thing string, soc int, month_no int, ep_no int, pos int, voltage double",
    )
    got = align.trace_overlay(trace, "a", every=3).collect()
    assert {(r.thing, r.ep_no) for r in got} == {("a", 3), ("a", 6)}
    assert all((r.voltage_100, r.voltage_95, r.voltage_85) == (100 + r.pos, 95 + r.pos, 85 + r.pos) for r in got)


def vectors(spark, n=240, width=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, width)) + 0.05 * rng.normal(size=(n, width)) + 4
    rows = [(i, int(i % 4), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, fold int, x array<double>").repartition(5), x


def test_models_equal_direct_components(spark):
    df, x = vectors(spark)
    models = reconstruct.fit_splits(df, [0, 1, 2], 2)
    for left_out, model in models.items():
        train = np.array([row for i, row in enumerate(x) if i % 4 in {0, 1, 2} - {left_out}])
        assert np.allclose(model.mean, train.mean(axis=0))
        _, _, v = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)
        assert np.allclose(model.components @ model.components.T, v[:2].T @ v[:2])
    scored = {r.id: (r.model, r.mae) for r in reconstruct.validation_scores(df, models).collect()}
    assert len(scored) == 180
    for i, (name, mae) in scored.items():
        model = models[i % 4]
        assert name == model.name == f"K_{i % 4 + 1}"
        assert mae == pytest.approx(np.abs(x[i] - model.reconstruct(x[i])).mean())


def test_full_basis_reconstructs_and_error_falls(spark):
    df, x = vectors(spark)
    full = reconstruct.fit_one(df, 6)
    hats = reconstruct.reconstruct(df.withColumn("model", F.lit("model")), [full])
    assert hats.select(F.max(numeric.array_mae(F.col("x"), F.col("x_hat")))).first()[0] < 1e-9
    errors = reconstruct.size_errors(df, full, [1, 2, 6]).groupBy("size").agg(F.avg("huber").alias("h"))
    by_size = {r["size"]: r.h for r in errors.collect()}
    assert set(by_size) == {1, 2, 6} and by_size[1] > by_size[2] > by_size[6]
    flipped = reconstruct.LinearModel("model", full.mean, -full.components)
    assert np.allclose(flipped.reconstruct(x), full.reconstruct(x))


def test_a_large_mean_does_not_cancel_a_small_variance(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6))
    far = spark.createDataFrame([((1e8 + row).tolist(),) for row in spread], "x array<double>")
    model = reconstruct.fit_one(far, 2)
    gaps = np.abs(1e8 + spread - model.reconstruct(1e8 + spread))
    assert gaps.max() < 1e-5 and np.abs(model.mean - 1e8 - spread.mean(axis=0)).max() < 1e-6
    with pytest.raises(ValueError, match="no sample"):
        reconstruct.fit_one(far.limit(0), 2)


def test_models_survive_a_table(spark, tmp_path):
    df, x = vectors(spark)
    model = reconstruct.fit_one(df, 3)
    reconstruct.models_table(spark, [model]).write.parquet(str(tmp_path / "models"))
    (loaded,) = reconstruct.models_from_table(spark.read.parquet(str(tmp_path / "models")))
    assert loaded.name == model.name and np.allclose(loaded.encode(x), model.encode(x))
    shown = reconstruct.project(df, model).orderBy("id").limit(3).collect()
    assert np.allclose([[r.axis_1, r.axis_2] for r in shown], model.encode(x[:3])[:, :2])
