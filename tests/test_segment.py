import datetime as dt
import random

import brute
import pytest
from pyspark.sql import functions as F

from ampwise.operators import blows, episodes, segment
from ampwise.schema import EPISODE, MONTH, Params

TWOS = Params(2, 2, 2, 2)
LETTERS = {"D": -20.0, "S": 0.0, "C": 20.0, "d": -10.0, "c": 10.0}
T0 = dt.datetime(2024, 1, 1)

# name: signal, start, status, end; None for no candidate.
TRACES = {
    "valid": ("DSSDDCCSSSSD", 3, "valid", 9),
    "abuts": ("DSSDDCCSSSD", 3, "inconsistent", 9),
    "first_run_dropped": ("SSDDCCSSSSD", None, None, None),
    "last_start_dropped": ("DSSDDCCSSSS", None, None, None),
    "short_context": ("DCSDDCCSSSSD", 3, "context", None),
    "short_discharge": ("DSSDCCSSSSD", 3, "noise", None),
    "little_charge": ("DSSDDCSSSSSD", 3, "incomplete", None),
    "no_end_rest": ("DSSDDCCCCCSD", 3, "incomplete", None),
    "split_charge": ("DSSDDCSCSSSSD", 3, "valid", 10),
    "minus10_discharge": ("DSSddCCSSSSD", 3, "valid", 9),
    "plus10_context": ("DccDDCCSSSSD", 3, "valid", 9),
    "end_on_next_start": ("DSSDDCCCSdSSS", 3, "inconsistent", 10),
    "end_at_month_end": ("DSSDDCCCSd", 3, "incomplete", None),
}


def telemetry(spark, signals, start=T0):
    """``signals``: thing -> list of (second, current)."""
    rows = [
        (thing, start + dt.timedelta(seconds=second), i, float(cur), 24.0 + i % 7)
        for thing, signal in signals.items()
        for i, (second, cur) in enumerate(signal)
    ]
    return spark.createDataFrame(rows, "thing string, ts timestamp, seq long, current double, voltage double")


def lettered(text, shift=lambda i: i):
    return [(shift(i), LETTERS[c]) for i, c in enumerate(text)]


def found(df):
    out = {}
    for r in df.select("thing", "start_rn", "next_rn", "end_rn", "status").collect():
        out.setdefault(r.thing, []).append((r.start_rn, r.next_rn, r.end_rn, r.status))
    return {thing: sorted(rows) for thing, rows in out.items()}


def test_hand_made_traces(spark):
    signals = {name: lettered(text) for name, (text, *_) in TRACES.items()}
    signals["hole"] = lettered("DSSDDCCSSSSD", lambda i: i + (5 if i >= 6 else 0))
    got = found(segment.candidates(telemetry(spark, signals), TWOS))
    for name, (_, start, status, end) in TRACES.items():
        if start is None:
            assert name not in got
        else:
            assert [(c[0], c[3], c[2]) for c in got[name]] == [(start, status, end)], name
    assert [(c[0], c[3], c[2]) for c in got["hole"]] == [(3, "inconsistent", 9)]


def random_signals(seed, things=12, rows=260):
    rng = random.Random(seed)
    levels = [-20.0, -10.0, 0.0, 10.0, 20.0]
    signals = {}
    for t in range(things):
        second, signal = 0, []
        while len(signal) < rows:
            level = rng.choice(levels if t % 2 else [-20.0, 0.0, 20.0, 0.0])
            for _ in range(rng.randint(1, 6)):
                signal.append((second, level))
                second += rng.choice([1, 1, 1, 1, 1, 1, 2, 4])
        signals[f"t{t}"] = signal[:rows]
    return signals


@pytest.mark.parametrize("clean", [False, True])
@pytest.mark.parametrize("sizes", [(1, 1, 1, 1), (2, 3, 2, 1), (3, 1, 1, 4)])
def test_random_signals_match_loop(spark, clean, sizes):
    p = Params(*sizes)
    signals = random_signals(sum(sizes) + clean)
    mode = segment.CLEAN_DISCHARGE if clean else segment.SWAB_TO_SWAB
    got = found(segment.candidates(telemetry(spark, signals), p, mode))
    for thing, signal in signals.items():
        want = brute.candidates([s * 1_000_000 for s, _ in signal], [c for _, c in signal], p, clean)
        assert got.get(thing, []) == want, thing


@pytest.mark.parametrize("clean", [False, True])
def test_pieces_give_the_same_result(spark, clean):
    p = Params(2, 3, 2, 1)
    signals = random_signals(7, things=3, rows=400)
    signals["quiet"] = lettered("DSSDDCCSSSSSSD")
    mode = segment.CLEAN_DISCHARGE if clean else segment.SWAB_TO_SWAB
    df = telemetry(spark, signals)
    hot = segment.find_hot_months(df, max_rows=50)
    assert sorted(r.thing for r in hot.collect()) == ["t0", "t1", "t2"]
    whole = segment.candidates(df, p, mode)
    pieces = segment.candidates(df, p, mode, hot)
    assert found(pieces) == found(whole)
    months = segment.months(df)
    heads = segment.headers(whole, months)
    split_heads = segment.headers(pieces, months, in_pieces=True)
    assert sorted(map(tuple, split_heads.select(*heads.columns).collect())) == sorted(map(tuple, heads.collect()))
    rows = episodes.episode_rows(df, heads, p)
    split_rows = episodes.episode_rows(df, split_heads, p, hot)
    assert sorted(map(tuple, split_rows.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = blows.extract_blows(rows, p)
    two = blows.extract_blows(split_rows, p, one_pass=False)
    assert sorted(map(tuple, two.select(*one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_pieces_smaller_than_the_frames(spark):
    """Borders reach over several pieces when pieces are shorter than a frame."""
    from ampwise.operators.ordering import find_hot

    p = Params(6, 6, 5, 2)
    signals = {"a": [(i, (0.0, -20.0, 20.0, 1.0)[(i // 12) % 4]) for i in range(400)]}
    df = telemetry(spark, signals)
    hot = find_hot(segment.dated(df), MONTH, max_rows=100, pieces=200)
    assert found(segment.candidates(df, p, hot=hot)) == found(segment.candidates(df, p))
    assert found(segment.candidates(df, p))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_dominant_timestamp_is_split(spark, seed):
    """Most rows of the month have one time, in the order of ``seq``; pieces cut through them."""
    rng = random.Random(seed)
    states = [rng.choice([0.0, 0.0, -20.0, 20.0]) for _ in range(900)]
    rows = [("a", T0 + dt.timedelta(seconds=i if i < 150 else 150 if i < 750 else i), i, c, 24.0) for i, c in enumerate(states)]
    rows += [("b", T0 + dt.timedelta(seconds=i), i, c, 24.0) for i, c in enumerate(states[:90])]
    df = spark.createDataFrame(rows, "thing string, ts timestamp, seq long, current double, voltage double").repartition(4)
    p = Params(1, 1, 1, 1)
    hot = segment.find_hot_months(df, max_rows=100)
    assert [(r.thing, r._pieces) for r in hot.collect()] == [("a", 9)]
    whole, pieces = segment.candidates(df, p), segment.candidates(df, p, hot=hot)
    assert found(pieces) == found(whole) and found(whole)
    months = segment.months(df)
    heads, split_heads = segment.headers(whole, months), segment.headers(pieces, months, in_pieces=True)
    rows, split = episodes.episode_rows(df, heads, p), episodes.episode_rows(df, split_heads, p, hot)
    assert sorted(map(tuple, split.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_valid_episodes_do_not_overlap(spark):
    p = Params(1, 1, 1, 1)
    df = telemetry(spark, {t: [(i, c) for i, (_, c) in enumerate(s)] for t, s in random_signals(3).items()})
    got = found(segment.candidates(df, p).where("status = 'valid'"))
    assert got
    for spans in got.values():
        for (_, _, end, _), (start, *_) in zip(spans, spans[1:]):
            assert end <= start - p.eps1


def test_months_are_separate(spark):
    start = dt.datetime(2024, 1, 31, 23, 59, 53)
    df = telemetry(spark, {"a": lettered("DSSDDCCSSSSDSS")}, start)
    # Seven rows fall into January; neither half holds a start with a successor.
    assert found(segment.candidates(df, TWOS)) == {}
    months = {(r.year, r.month): r.month_idx for r in segment.months(df).collect()}
    assert months == {(2024, 1): 0, (2024, 2): 1}


def test_equal_timestamps_follow_seq(spark):
    signal = lettered("DSSDDCCSSSSD", lambda i: i if i < 8 else i - (i == 8))
    got = found(segment.candidates(telemetry(spark, {"a": signal}), TWOS))
    want = brute.candidates([s * 1_000_000 for s, _ in signal], [c for _, c in signal], TWOS)
    assert got["a"] == want


def test_unknown_mode_falls_back(spark):
    df = telemetry(spark, {"a": lettered(TRACES["valid"][0])})
    assert found(segment.candidates(df, TWOS, "other")) == found(segment.candidates(df, TWOS))


def test_blows_match_slicing(spark):
    p = Params(2, 2, 3, 4)
    rng = random.Random(5)
    signals = {f"e{i}": [rng.choice([-20.0, -10.0, 0.0, 10.0, 20.0]) for _ in range(rng.randint(3, 14))] for i in range(60)}
    rows = [(thing, 0, 0, pos, c) for thing, cur in signals.items() for pos, c in enumerate(cur)]
    df = spark.createDataFrame(rows, "thing string, month_idx int, ep_idx int, pos int, current double")
    for one_pass in (True, False):
        got = {}
        for r in blows.extract_blows(df, p, one_pass).collect():
            got.setdefault(r.thing, []).append((r.part, r.part_pos, r.blow_pos, r.pos))
        for thing, cur in signals.items():
            assert sorted(got.get(thing, [])) == sorted(brute.blow_rows(cur, p)), (thing, cur)


def test_shaped_blows_have_twenty_rows(spark, small_folder):
    from ampwise.plans.segment_queries import shaped_episodes
    from ampwise.schema import FIVES

    _, rows, one_pass = shaped_episodes(spark, small_folder)
    widths = blows.extract_blows(rows, FIVES, one_pass).groupBy(*EPISODE).count().select("count").distinct()
    assert [r[0] for r in widths.collect()] == [FIVES.blow_rows] == [20]


def test_in_months_follows_the_list(spark):
    df = spark.createDataFrame([("a", m) for m in range(4)], "thing string, month_idx int")
    got = blows.in_months(df, [2, 0]).select("month_idx", "month_order").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (2, 0)]
    assert blows.in_months(df, []).count() == 4


def test_odd_widths_are_dropped(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "k string, i int")
    assert {r.k for r in blows.drop_odd_widths(df, ["k"], 3).collect()} == {"a"}


def test_single_shuffle(spark, small_folder):
    """Segmentation of the event signal needs one exchange."""
    from ampwise.sources import views

    df, hot = views.events_telemetry(spark, small_folder)
    plan = segment.candidates(df, Params(1, 1, 1, 1, 1, 40_000), hot=hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_names_come_from_the_last_month(spark):
    rows = [("a", 0, 0, 0, "x"), ("a", 2, 0, 0, "y"), ("a", 2, 0, 1, "z"), ("a", 2, 1, 0, "w")]
    df = spark.createDataFrame(rows, "thing string, month_idx int, ep_idx int, pos int, name string")
    assert episodes.thing_names(df, "name").first().name == "y"


def test_summary_keeps_empty_months(spark):
    lengths = spark.createDataFrame([("a", 0, 0, 5)], "thing string, month_idx int, ep_idx int, rows int")
    months = spark.createDataFrame([("a", 0), ("a", 1)], "thing string, month_idx int")
    table = episodes.summary(lengths, months).where(F.col("level") == "thing_month").orderBy("month_idx").collect()
    assert [(r.month_idx, r.episodes, r.min_rows) for r in table] == [(0, 1, 5), (1, 0, None)]
