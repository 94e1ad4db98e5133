"""Left-out models per group against numpy, with hot groups in shares and little memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampwise.operators import group_models

SCHEMA = "id long, label string, x array<double>"


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(2)
    labels = np.array(["hot"] * 300 + ["a", "b"] * 60 + ["one"])
    x = r.normal(size=(len(labels), 9)) @ r.normal(size=(9, 9)) + 50 + 5 * (labels == "a")[:, None]
    return labels, x


def plain(labels, x, size):
    out = {}
    for label in set(labels):
        rest = x[labels != label]
        mean = rest.mean(axis=0)
        values, vectors = np.linalg.eigh(np.cov(rest.T, bias=True))
        axes = vectors[:, ::-1][:, :size]
        gap = x[labels == label] - mean
        out[label] = (len(rest), values[::-1][:size], np.abs(gap - gap @ axes @ axes.T).mean(axis=1))
    return out


@pytest.mark.parametrize("share_rows, held_bytes", [(65_536, 64 << 20), (40, 64 << 20), (40, 1)])
def test_left_out_models(spark, data, monkeypatch, share_rows, held_bytes):
    monkeypatch.setattr(group_models, "SHARE_ROWS", share_rows)
    monkeypatch.setattr(group_models, "HELD_BYTES", held_bytes)
    labels, x = data
    rows = [(k, label, v.tolist()) for k, (label, v) in enumerate(zip(labels.tolist(), x))]
    samples = spark.createDataFrame(rows, SCHEMA).repartition(7)
    models = group_models.fit_left_out(samples, "label", 4)
    want = plain(labels, x, 4)
    found = {m.label: m for m in models.collect()}
    assert found.keys() == want.keys()
    for label, m in found.items():
        assert m.n == want[label][0] and np.allclose(m.variances, want[label][1]) and m.residual < 1e-9
    scored = {r.id: r.mae for r in group_models.score_by(samples, models, "label").collect()}
    assert len(scored) == len(rows)
    for label in want:
        assert np.allclose([scored[k] for k in np.flatnonzero(labels == label)], want[label][2])


def test_groups_without_a_rest(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert group_models.fit_left_out(none, "label", 2).count() == 0
    alone = spark.createDataFrame([(k, "a", [float(k), 1.0]) for k in range(5)], SCHEMA)
    models = group_models.fit_left_out(alone, "label", 2)
    assert models.count() == 0 and group_models.score_by(alone, models, "label").count() == 0
    two = alone.unionByName(spark.createDataFrame([(9, "b", [3.0, 2.0])], SCHEMA))
    models = {m.label: m for m in group_models.fit_left_out(two, "label", 2).collect()}
    assert models["a"].n == 1 and models["a"].mean == [3.0, 2.0] and models["b"].n == 5
    assert group_models.score_by(two, group_models.fit_left_out(two, "label", 2), "label").agg(F.count("mae")).first()[0] == 6
