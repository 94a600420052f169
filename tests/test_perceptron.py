"""The perceptron's learner takes every row."""

from pathlib import Path

import numpy as np
import pytest

from tidalspan.ml import learners as L
from tidalspan.plans import models

FOLDER = Path("/root/testdata/sf0.01")


def _watch(monkeypatch):
    seen, gradient = [], L.Perceptron.gradient

    def watched(self, x, y):
        seen.append(x.copy())
        return gradient(self, x, y)

    monkeypatch.setattr(L.Perceptron, "gradient", watched)
    return seen


@pytest.mark.parametrize("held", [64, 1000])
def test_each_epoch_has_every_row(spark, monkeypatch, held):
    seen = _watch(monkeypatch)
    frame = spark.range(300).selectExpr("double(id) / 300 AS x", "double(id) AS y").unionAll(spark.sql("SELECT double(NULL), 1D"))
    L.MlpLearner((4,), 2, 1e-2, 32, 10, held).learn(frame, ["x"], ["y"])
    rows = np.concatenate(seen)[:, 0]
    want = np.arange(300) / 300
    assert np.allclose(np.sort(rows[:300]), want) and np.allclose(np.sort(rows[300:]), want)
    assert not np.allclose(rows[:300], rows[300:])


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data")
def test_query_trains_on_every_event(spark, monkeypatch):
    seen = _watch(monkeypatch)
    models.QUERIES["L07_perceptron"](spark, str(FOLDER))
    assert sum(map(len, seen)) == 2 * spark.read.parquet(str(FOLDER / "events.parquet")).dropna(subset=["value", "ts"]).count()
