"""Stores that change in one step: builds killed at any point, replaced keys, reruns, expiry."""

import pytest

from ampwise.sources import snapshots, stores

ROWS = "thing string, month_idx int, ep_idx int, pos int, current double"
MONTHS = "thing string, year int, month int, month_idx int"


def build(spark, path, things, value):
    rows = spark.createDataFrame([(t, 0, e, i, value) for t, n in things.items() for e in range(n) for i in range(3)], ROWS)
    months = spark.createDataFrame([(t, 2024, 1, 0) for t in things], MONTHS)
    stores.save_episodes(rows, months, path)


def state(spark, path):
    rows = stores.load_episodes(spark, path)
    held = {} if rows is None else {(r.thing, r.current): r["count"] for r in rows.groupBy("thing", "current").count().collect()}
    return held, {(r.thing, r.has_episodes) for r in stores.load_months(spark, path).collect()}


def test_builds_replace_only_their_things(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stores.load_episodes(spark, path) is None and stores.stored_things(spark, path) is None
    build(spark, path, {"007": 2, "b": 1, "none": 0}, 1.0)
    assert state(spark, path) == ({("007", 1.0): 6, ("b", 1.0): 3}, {("007", True), ("b", True), ("none", False)})
    build(spark, path, {"b": 4, "c": 1, "none": 1}, 2.0)
    want = {("007", 1.0): 6, ("b", 2.0): 12, ("c", 2.0): 3, ("none", 2.0): 3}
    assert state(spark, path)[0] == want
    for _ in range(2):  # the same build again changes nothing
        build(spark, path, {"b": 4, "c": 1, "none": 1}, 2.0)
        assert state(spark, path)[0] == want
    build(spark, path, {"c": 0}, 3.0)  # without episodes now
    assert state(spark, path) == ({k: n for k, n in want.items() if k[0] != "c"}, {("007", True), ("b", True), ("c", False), ("none", True)})
    assert stores.load_episodes(spark, path, "c") is None
    assert {r.thing for r in stores.load_episodes(spark, path, "007").select("thing").distinct().collect()} == {"007"}
    before = state(spark, path)
    assert len(snapshots.expire(spark, path)) == 2 and snapshots.expire(spark, path) == []
    assert state(spark, path) == before


@pytest.mark.parametrize("step", ["rows", "months", "manifest", "marker"])
def test_a_killed_build_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "store")
    build(spark, path, {"a": 1, "b": 1}, 1.0)
    before = state(spark, path)

    def killed(*_):
        raise KeyboardInterrupt

    if step == "manifest":
        monkeypatch.setattr(snapshots, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            build(spark, path, {"a": 2, "c": 1}, 2.0)
    else:
        build(spark, path, {"a": 2, "c": 1}, 2.0)
        # As a kill in the middle of a write leaves it: files, but no marker, and nothing of the later steps.
        last = snapshots.children(spark, f"{path}/manifests")[-1]
        if step == "marker":
            snapshots.delete(spark, f"{path}/manifests/{last}/_SUCCESS")
        else:
            snapshots.delete(spark, f"{path}/manifests/{last}")
            if step == "rows":
                (newest,) = {f for f in snapshots.children(spark, f"{path}/months")} - {
                    "version=" + r.version for r in snapshots.manifest(spark, path).collect()
                }
                snapshots.delete(spark, f"{path}/months/{newest}")
    monkeypatch.undo()
    assert state(spark, path) == before
    build(spark, path, {"a": 2, "c": 1}, 2.0)
    assert state(spark, path) == ({("a", 2.0): 6, ("b", 1.0): 3, ("c", 2.0): 3}, {("a", True), ("b", True), ("c", True)})


def test_two_builds_at_once(spark, tmp_path, monkeypatch):
    """The one that commits second has not seen the first; it fails, and its rows are not read."""
    path = str(tmp_path / "store")
    build(spark, path, {"a": 1}, 1.0)
    real, raced = snapshots.manifest, []  # the first build begins and ends while the second one works

    def slow(session, where):
        found = real(session, where)
        if not raced:
            raced.append(True)
            build(spark, path, {"b": 1}, 2.0)
        return found

    monkeypatch.setattr(snapshots, "manifest", slow)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        build(spark, path, {"c": 1}, 3.0)
    monkeypatch.undo()
    assert set(state(spark, path)[0]) == {("a", 1.0), ("b", 2.0)}
