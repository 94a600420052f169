"""Kernels against plain versions, and their work on long series."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalspan.functions import series as S
from tidalspan.ml import learners as L
from tidalspan.operators import kernels
from tidalspan.operators.series import SliceTimeSeries
from tidalspan.sources import frames


def dense_cubic(x, y, at):
    n = len(x)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1], b[i] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i], 6 * (slope[i] - slope[i - 1])
    a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v, w = at - x[k], x[k + 1] - at, h[k]
    return (m[k] * v**3 + m[k + 1] * u**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * v + (y[k + 1] / w - m[k + 1] * w / 6) * u


@pytest.mark.parametrize("n", [4, 5, 6, 40, 300])
def test_cubic_spline(n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.1, 2, n)), rng.normal(size=n)
    at = np.linspace(x[0], x[-1], 5 * n)
    assert kernels.cubic(x, y, at) == pytest.approx(dense_cubic(x, y, at), abs=1e-9)
    assert kernels.cubic(x, x**3 - x, at) == pytest.approx(at**3 - at, rel=1e-9, abs=1e-6)  # a cubic is met exactly


def plain_filter(sections, x):
    y = list(x)
    for b0, b1, b2, a1, a2 in sections.tolist():
        s1 = s2 = 0.0
        for k, v in enumerate(y):
            y[k] = b0 * v + s1
            s1, s2 = b1 * v - a1 * y[k] + s2, b2 * v - a2 * y[k]
    return np.array(y)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 5000, 20011])
@pytest.mark.parametrize("kind", ["lowpass", "highpass"])
def test_filter_by_blocks(n, kind):
    sections = kernels.butterworth(5, 0.03, 1.0, kind)
    x = np.random.default_rng(n).normal(size=n)
    assert kernels.filtered(sections, x) == pytest.approx(plain_filter(sections, x), abs=1e-9)


def test_long_series_take_seconds():
    n = 1_000_000
    x = np.arange(n) + 0.25 * np.sin(np.arange(n))
    start = time.time()
    assert len(kernels.cubic(x, np.cos(x / 50), x)) == n
    assert len(kernels.filtered(kernels.butterworth(5, 0.01, 1.0, "lowpass"), np.cos(x))) == n
    assert time.time() - start < 20


def test_mode_and_slices_of_a_long_series(spark):
    n = 200_000
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.cast("double").alias("time"), F.when(k % 5 == 0, 7.0).otherwise(k.cast("double")).alias("value"))).alias("s"),
        F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: (k * 200).cast("double")).alias("p"), F.lit("kept").alias("other"),
    )
    start = time.time()
    assert df.select(S.mode("s")).first()[0] == 7.0
    got = SliceTimeSeries("s", "p").apply(df).select("other", F.size("s").alias("n"), F.element_at("s", 1)["time"].alias("t")).collect()
    assert len(got) == 1000 and {r["other"] for r in got} == {"kept"} and sum(r["n"] for r in got) == n
    assert sorted(r["t"] for r in got)[:2] == [0.0, 201.0] and time.time() - start < 30


def test_modes(spark):
    rows = [(1, [1.0, 2.0, 2.0, 1.0, 3.0]), (2, []), (3, [5.0]), (4, [None, 4.0, None]), (5, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>").withColumn("s", F.transform("v", lambda v: F.struct(F.lit(0.0).alias("time"), v.alias("value"))))
    assert {r[0]: r[1] for r in df.select("k", S.mode("s")).collect()} == {1: 2.0, 2: None, 3: 5.0, 4: 4.0, 5: None}


def test_slices_with_nulls(spark):
    series = [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]
    rows = [(1, series, [2.0, None, 2.0, -1.0]), (2, None, [1.0]), (3, series, None), (4, [], [1.0]), (5, series, [])]
    df = spark.createDataFrame(rows, "k int, s array<struct<time:double,value:double>>, p array<double>")
    times = lambda d: sorted((r["k"], [x["time"] for x in r["s"]]) for r in d.collect())
    assert times(SliceTimeSeries("s", "p").apply(df)) == [(1, [1.0, 2.0]), (1, [3.0]), (5, [1.0, 2.0, 3.0])]
    assert times(SliceTimeSeries("s", "p", keep_tail=False).apply(df)) == [(1, [1.0, 2.0])]


def test_regression_far_from_zero(spark):
    rng = np.random.default_rng(0)
    rows = [(1.7e9 + float(u), 5.0, float(v), 3 * float(u) - 2 * float(v) + 5) for u, v in zip(rng.uniform(0, 1000, 500), rng.normal(size=500), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "x double, constant double, z double, y double")
    model = L.LinearRegression().learn(df, ["x", "constant", "z"], ["y"])
    assert model.weights["y"][:3] == pytest.approx([3, 0, -2], abs=1e-6)
    assert model.predict(df.dropna()).agg(F.max(F.abs(F.col("y") - F.col("y_predicted")))).first()[0] < 1e-3
    assert L.LinearRegression().learn(df.limit(0), ["x"], ["y"]).weights == {"y": [0.0, 0.0]}


@pytest.mark.parametrize("per_row", [False, True])
def test_incremental_steps(spark, per_row):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(60, 2)), np.zeros((3, 2))
    y = np.stack([x @ [2, -1] + 1, x @ [0, 3]], axis=1)
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double, z double").coalesce(1)
    learner = L.IncrementalLinear(0.05, per_row)
    for _ in range(3):
        model = learner.learn_incremental(df, ["a", "b"], ["y", "z"])
        one = np.hstack([x, np.ones((60, 1))])
        for part in ([k] for k in range(60)) if per_row else [list(range(60))]:
            w -= 0.05 * 2 * one[part].T @ (one[part] @ w - y[part]) / len(part)
    assert [model.weights["y"], model.weights["z"]] == [pytest.approx(w[:, 0]), pytest.approx(w[:, 1])]


def test_row_numbers_of_a_frequent_key(spark):
    """One key on two thirds of the rows fills several ranges; reruns agree."""
    rows = [(1 if k % 3 else k, f"r{k}") for k in range(3000)]
    number = lambda df: {r["name"]: r["_row"] for r in frames.with_row_number(df, "k").collect()}
    df = spark.createDataFrame(rows, "k long, name string")
    got = number(df)
    assert sorted(got.values()) == list(range(1, 3001)) and got == number(df.repartition(7))
    keys = {name: k for k, name in rows}
    ordered = [keys[n] for n in sorted(got, key=got.get)]
    assert ordered == sorted(ordered)


def test_adapter_results_go_to_files(spark, tmp_path, monkeypatch):
    from tidalspan.errors import Finished

    monkeypatch.setattr(frames.FrameAdapter, "KEPT", 4)
    adapter = frames.FrameAdapter(spark.range(10), "id", folder=f"{tmp_path}/out")
    adapter.start()
    with pytest.raises(Finished):
        while True:
            adapter.send_data(adapter.get_data())
    assert len(adapter.results) == 2 and sorted(r["id"] for r in adapter.stop().collect()) == list(range(10))
