"""Draws by number against numpy's sequential generator, and what is built on them against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampwise.functions import twister
from ampwise.operators import folds, metrics


@pytest.mark.parametrize("seed", [0, 42, 4988, 20091017])
def test_jumps_agree_with_the_sequential_generator(seed):
    whole = np.random.RandomState(seed).random_sample(200_000)
    for at in (0, 1, 311, 312, 313, 5_000, 123_457):
        state = twister.jumped(twister.seeded(seed), 2 * at)
        assert np.array_equal(twister.generator(state).random_sample(700), whole[at : at + 700])
    one = twister.jumped(twister.seeded(seed), 10**12 + 7)
    two = twister.jumped(twister.jumped(twister.seeded(seed), 10**12), 7)
    assert np.array_equal(twister.generator(one).random_sample(50), twister.generator(two).random_sample(50))


def test_draws_in_parallel(spark):
    for count in (0, 1, 100_000):
        rows = sorted((r.draw, r.u) for r in twister.draws(spark, count, 42).collect())
        assert [d for d, _ in rows] == list(range(count))
        assert np.array_equal(np.array([u for _, u in rows]), np.random.RandomState(42).random_sample(count))
    assert twister.draws(spark, 100_000, 42).rdd.getNumPartitions() > 1


def test_permutation_and_what_follows_it(spark):
    for count in (1, 2, 1000):
        made = np.random.RandomState(7)
        want = made.permutation(count).tolist()
        rows = sorted((r.place, r["item"]) for r in twister.permutation(spark, count, 7).collect())
        assert [item for _, item in rows] == want and [place for place, _ in rows] == list(range(count))
        state = twister.after_permutation(spark, count, 7)
        assert np.array_equal(twister.generator(state).random_sample(30), made.random_sample(30))


def test_population_of_a_sequential_run(spark):
    sizes = {"K_1": 900, "K_2": 37}
    rows = [(m, soc, i, i / 1000 + soc) for m, n in sizes.items() for i in range(n) for soc in metrics.HEALTH_LEVELS]
    scores = spark.createDataFrame(rows, "model string, soc int, sample_id long, mae double").repartition(5)
    got = {(r.model, r.sample_id): r.soc for r in metrics.stream_population(scores).collect()}
    want = {}
    for model, n in sizes.items():
        for i, u in enumerate(np.random.RandomState(42).rand(n)):
            want[model, i] = next((soc for cut, soc in metrics.SWEEP_POPULATION if u >= cut), 100)
    assert got == want
    assert metrics.stream_population(scores.where("false")).count() == 0


def test_folds_of_a_sequential_run(spark):
    r = np.random.default_rng(3)
    sizes = {f"t{k:02}": int(r.integers(1, 9)) for k in range(25)}
    levels, cuts, k, seed = (100, 90, 80), [(0.2, 80), (0.5, 90)], 4, 4988
    rows = [(t, soc, m, e, m * 10 + e) for t, n in sizes.items() for soc in levels for m in range(2) for e in range(n)]
    frame = spark.createDataFrame(rows, "thing string, soc int, month_idx int, ep_idx int, v int").repartition(6)
    found = folds.stream_degraded_folds(frame, cuts, k, seed)
    got = {(x.thing, x.month_idx, x.ep_idx): (x.soc, x.fold) for x in found.collect()}
    made = np.random.RandomState(seed)
    names, want, fold, filled = sorted(sizes), {}, 0, 0
    cap = 2 * sum(sizes.values()) // k
    for item in made.permutation(len(names)):
        thing = names[item]
        picks = {}
        for m in range(2):
            for e in range(sizes[thing]):
                u = made.uniform(0, 1)
                picks[thing, m, e] = next((soc for cut, soc in cuts if u < cut), 100)
        n = 2 * sizes[thing]
        if filled + n > cap and fold < k - 1:
            fold, filled = fold + 1, n
        else:
            filled += n
        want |= {key: (soc, fold) for key, soc in picks.items()}
    assert got == want
    ordered = folds.stream_fold_map(folds.thing_sizes(frame.where(F.col("soc") == 100)), k, seed)
    assert {x.thing: x.fold for x in ordered.collect()} == {key[0]: f for key, (_, f) in want.items()}
