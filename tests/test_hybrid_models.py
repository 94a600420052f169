"""Hybrid models in use, simulation with inputs, the stream selector, surrogates, sheets, progress."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalspan.ml import learners as L
from tidalspan.sim import hybrid, modes, selector
from tidalspan.streaming import learning
from tidalspan.testing import generate, surrogate


@pytest.fixture(scope="module")
def model(spark):
    """Rises at 2 a second below 1, decays towards 0 above."""
    rows = [(k, k / 100, 2.0 if k < 100 else -0.5 * k / 100) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, dx double")
    return modes.learn_hybrid(df, "k", ["x"], "dx", ["x"], ["x"], start_width=20, step_width=20, threshold=1e-6, max_modes=3)


def test_diagnostics(spark, model):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "x double")
    got = {r["x"]: r for r in model.predict_with_diagnostics(df).collect()}
    assert (got[0.5]["selected_mode"], got[1.5]["selected_mode"]) == (0, 1) and got[0.5]["dx_predicted"] == pytest.approx(2) and got[1.5]["dx_predicted"] == pytest.approx(-0.75)
    assert got[0.5]["leaf"] != got[1.5]["leaf"] and max(got[0.5]["mode_probabilities"]) == 1
    assert not got[None]["ready"] and got[None]["dx_predicted"] is None and got[0.5]["ready"]


def test_integration_of_a_learnt_model(spark, model):
    assert model.predict_next_state([0.2], 0.0, 0.1) == pytest.approx([0.4])
    assert model.predict_next_state([1.5], 0.0, 0.5) == pytest.approx([1.5 * np.exp(-0.25)], rel=1e-5)
    trace = model.simulate((0.0, 1.0), [0.8], sample_dt=0.25)
    want = [0.8, 1.3]
    for _ in range(3):
        want.append(want[-1] * np.exp(-0.125) if want[-1] > 0.995 else want[-1] + 0.5)
    assert trace.x[:, 0] == pytest.approx(want, rel=1e-5) and trace.location == ["mode_0", "mode_0", "mode_1", "mode_1", "mode_1"]
    with pytest.raises(ValueError):
        model.predict_next_state([0.2], 0.0, 0.0)
    with pytest.raises(ValueError):
        model.simulate((0.0, 1.0), [0.8])
    starts = spark.createDataFrame([(7, [0.8]), (8, [1.6])], "trace_id long, x0 array<double>")
    rows = model.simulate_frame(starts, (0.0, 1.0), 0.25).where("trace_id = 7").orderBy("step").collect()
    assert [r["x"] for r in rows] == pytest.approx(want, rel=1e-5) and [r["location"] for r in rows] == trace.location


def test_models_that_cannot_be_integrated(spark, model):
    lagged = modes.ModeModel(["x"], ["dx"], model.selector, model.modes, ["y"])
    with pytest.raises(ValueError, match="selector needs"):
        lagged.predict_next_state([0.2], 0.0, 0.1)
    with pytest.raises(ValueError):
        modes.ModeModel(["x"], ["dx"], None, model.modes)
    with pytest.raises(ValueError):
        modes.ModeModel(["x"], ["dx"], None, [])


def test_tree_function_agrees_with_the_tree(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), int(a > 0.3) + 2 * int(b * a > 0.2)) for a, b in rng.uniform(-1, 1, (500, 2))]
    df = spark.createDataFrame(rows, "a double, b double, mode long")
    tree = L.classification_tree(4).learn(df, ["a", "b"], ["mode"])
    decide = selector.tree_function(tree.models[0])
    assert [decide((r["a"], r["b"])) == r["mode_predicted"] for r in tree.predict(df).collect()] == [True] * 500


def test_simulation_with_inputs():
    system = hybrid.HybridSystem(
        {"fill": lambda t, x, u: np.array([u[0]]), "drain": lambda t, x, u: np.array([-1.0])},
        [hybrid.Transition("fill", "drain", lambda t, x, u: x[0] - 1.0, 1, lambda t, x, u: x)], "fill",
    )
    trace = hybrid.simulate(system, (0.0, 2.0), [0.0], inputs=lambda t: [1.0], capture_derivatives=True, sample_times=[0.0, 0.5, 1.5, 2.0], max_step=0.3)
    assert trace.x[:, 0] == pytest.approx([0, 0.5, 0.5, 0], abs=1e-6) and trace.u[:, 0].tolist() == [1.0] * 4
    assert trace.dx[:, 0].tolist() == [1.0, 1.0, -1.0, -1.0] and trace.location == ["fill", "fill", "drain", "drain"]
    assert hybrid.simulate(system, (0.0, 1.0), [0.0], inputs=lambda t: [0.0], capture_inputs=False).u is None
    for wrong in ({"sample_times": [0.5, 1.0]}, {"sample_times": [0.0, 1.0], "sample_dt": 0.1}):
        with pytest.raises(ValueError):
            hybrid.simulate(system, (0.0, 2.0), [0.0], inputs=lambda t: [1.0], **wrong)
    with pytest.raises(ValueError):
        hybrid.simulate(hybrid.bouncing_ball(), (0.0, 1.0), [1.0, 0.0], capture_inputs=True)
    names = hybrid.trace_columns(trace, ["level"], ["flow"])
    assert list(names) == ["step", "t", "location", "level", "dx_level", "u_flow"]


def test_stream_selector_over_several_batches(spark, tmp_path):
    """The state carries samples and modes from batch to batch."""
    rng = np.random.default_rng(3)
    rows = [(key, float(t), float(rng.normal()), 1) for t in range(30) for key in (1, 2)]
    schema = "key long, t double, value double, mode long"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    decide = lambda samples, before: (sum(before) + int(samples[0][0] > samples[-1][0])) % 4
    want = learning.select_modes(spark.createDataFrame(rows, schema), "key", "t", ["value"], 2, "mode", decide)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = learning.select_modes_on_stream(stream, ["value"], 2, decide)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["key"], r["t"]): (r["selected_mode"], r["ready"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == {(r["key"], r["t"]): (r["selected_mode"], r["t"] >= 2) for r in want.collect()}


def test_resampling_follows_the_density(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, float(a), float(round(b))) for k, (a, b) in enumerate(zip(rng.normal(5, 2, 2000), rng.normal(-3, 4, 2000), strict=True))], "k long, a double, b double")
    out = surrogate.resampled(df, ["a", "b"], 4000, "k", whole=["b"])
    r = out.agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.stddev("a").alias("sa"), F.avg("b").alias("mb"), F.max(F.abs(F.col("b") - F.round("b"))).alias("whole")).first()
    h = surrogate.silverman(2000, 2)
    assert r["n"] == 4000 and r["ma"] == pytest.approx(5, abs=0.2) and r["mb"] == pytest.approx(-3, abs=0.3) and r["sa"] == pytest.approx((4 + h * h) ** 0.5, rel=0.06) and r["whole"] == 0
    assert h == pytest.approx((2000 * 4 / 4) ** (-1 / 6))
    with pytest.raises(ValueError):
        surrogate.resampled(df.limit(0), ["a"], 5, "k")


def test_hoeffding_tree():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (6000, 3))
    y = np.where(x[:, 0] > 0.6, 2, np.where(x[:, 2] > 0.3, 1, 0))
    tree = surrogate.HoeffdingTree(3, cuts=50).learn(zip(x, y, strict=True))
    test = rng.uniform(0, 1, (1000, 3))
    right = np.where(test[:, 0] > 0.6, 2, np.where(test[:, 2] > 0.3, 1, 0))
    assert np.mean([tree.predict(a) == b for a, b in zip(test, right, strict=True)]) > 0.95
    boxes = tree.classes()
    assert len(boxes) >= 3 and all(sum(all(lo < v <= hi for v, (lo, hi) in zip(a, box, strict=True)) for box in boxes) == 1 for a in test[:50])
    assert surrogate.HoeffdingTree(1).predict([1.0]) == 0.0


def test_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "a<b"), (None, "")], "x double, y string")
    generate.save_excel(df, f"{tmp_path}/tests.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/tests.xlsx") as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert "<v>1.5</v>" in sheet and "a&lt;b" in sheet and sheet.count("<row>") == 3
    with pytest.raises(ValueError):
        generate.save_excel(df, f"{tmp_path}/more.xlsx", most=1)


def test_progress_line(spark):
    out = io.StringIO()
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(10)], "x double, y double")
    L.MlpLearner((2,), epochs=2, callbacks=[L.ProgressCallbacks(out, 4)]).learn(df, ["x"], ["y"])
    assert "[##..]" in out.getvalue() and "[####]" in out.getvalue() and out.getvalue().endswith("done\n")
    out = io.StringIO()
    with pytest.raises(Exception):  # noqa: B017
        L.regression_tree(callbacks=[L.ProgressCallbacks(out)]).learn(df, ["nope"], ["y"])
    assert "failed" in out.getvalue()


def test_models_are_saved_by_uri(spark, tmp_path):
    model = L.LinearModel(["x"], ["y"], {"y": [2.0, 1.0]})
    for path in (f"{tmp_path}/m.bin", f"file://{tmp_path}/n.bin"):
        model.save(path)
        assert L.Model.load(path).weights == model.weights
