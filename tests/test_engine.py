"""Sources, models, streams, simulation and test generation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalspan.errors import Finished, InvalidUriSchemeError, TestFailed, UnsupportedFileTypeError
from tidalspan.ml import learners as L
from tidalspan.ml import metrics as M
from tidalspan.ml import strategies
from tidalspan.operators.relational import Rename
from tidalspan.sim import hybrid, modes, ode
from tidalspan.sources import frames as S
from tidalspan.streaming import learning
from tidalspan.testing import generate as G


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" A , B\n1,2\n3,4\n")
    (tmp_path / "a.json").write_text('[{"A": 1, "B": 2}, {"A": 3, "B": 4}]')
    (tmp_path / "one.json").write_text('{"A": 1, "B": 2}')
    (tmp_path / "a.yaml").write_text("- {A: 1, B: 2}\n- {A: 3, B: 4}\n")
    spark.createDataFrame([(1, 2), (3, 4)], "A long, B long").write.parquet(f"{tmp_path}/a.parquet")
    for kind in ("csv", "json", "yaml", "parquet"):
        df = S.read_uri(spark, f"file:{tmp_path}/a.{kind}")
        assert df.columns == ["A", "B"] and rows(df) == [(1, 2), (3, 4)]
    assert rows(S.read_json(spark, f"{tmp_path}/one.json")) == [(1, 2)]
    assert S.path_of_uri("file:relative/path/to/data.csv") == "relative/path/to/data.csv"
    with pytest.raises(InvalidUriSchemeError):
        S.read_uri(spark, "http://example.org/data.csv")
    with pytest.raises(UnsupportedFileTypeError):
        S.read_uri(spark, "file:a.txt")
    assert len(list(S.build_from_directory(str(tmp_path), str, "*.json"))) == 2


def test_environments(spark):
    a, b = (S.Environment(spark.createDataFrame(r, "A long, B long")) for r in ([(1, 2), (3, 4)], [(5, 6), (7, 8)]))
    assert rows((a + b).collect()) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    assert [rows(f)[0][0] for f in a + b] == [1, 5]
    assert (a | Rename({"A": "x"})).observe().columns == ["x", "B"] and len(a) == 2
    with pytest.raises(ValueError):
        S.Chained([])
    batches = a.chain(b).collect()
    got = [sorted(r["A"] for r in f.collect()) for f in S.Batches(batches, "A", 3)]
    assert got == [[1, 3, 5], [7]]


def test_split(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 7)], "a long")
    assert [rows(p) for p in S.train_test_split(df, 0.8, "a")] == [[(1,), (2,), (3,), (4,)], [(5,), (6,)]]
    first, again = (S.train_test_split(df, 0.8, "a", shuffle=True, seed=42) for _ in range(2))
    assert [rows(p) for p in first] == [rows(p) for p in again] and first[0].count() == 4 and not set(rows(first[0])) & set(rows(first[1]))
    with pytest.raises(ValueError):
        S.train_test_split(df, 1.5, "a")


def test_row_numbers_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.lit(999) - F.col("id")).alias("a"))
    assert all(r["a"] + 1 == r["_row"] for r in S.with_row_number(df, "a").collect())


def test_adapter(spark):
    adapter = S.FrameAdapter(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "A long, B long"), "A", ["B"])
    strategies.prediction_loop(L.DummyModel(["B"], ["data"]), adapter)
    assert [r["B"] for r in adapter.results] == [2, 4, 6]
    with pytest.raises(Finished):
        adapter.get_data()


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1], [1, 1, 0, 0], strict=True)), "a long, p long")
    got = M.evaluate(df, [("a", "p")], [M.Accuracy(), M.FBetaScore(1.0), M.PrecisionScore(), M.Recall(), M.MaxError("a"), M.MeanAbsoluteError(), M.MeanSquaredError(), M.R2Score()])
    assert got == {"Accuracy": 0.5, "FBetaScore": 0.5, "PrecisionScore": 0.5, "Recall": 0.5, "MaxError": 1, "MeanAbsoluteError": {"a": 0.5}, "MeanSquaredError": {"a": 0.5}, "R2Score": {"a": -1.0}}
    assert "accuracy" in M.ClassificationReport().compute(df, [("a", "p")]) and "| 0.5000" in str(M.Report({"m": got}))
    assert M.MeanAbsoluteError("uniform_average").compute(df, [("a", "p")]) == 0.5
    nothing = df.where("a > 5")
    assert M.PrecisionScore().compute(nothing, [("a", "p")]) == 0


def test_threshold(spark):
    df = spark.createDataFrame([(int(k >= 60), k / 100) for k in range(100)], "y int, p double")
    assert M.tune_threshold(df, "y", "p") == (pytest.approx(0.6), 1.0)


@pytest.fixture
def linear(spark):
    return spark.createDataFrame([(k, k / 100, (100 - k) / 100, float(k % 2)) for k in range(100)], "k long, x double, y double, z double")


def test_linear_models(spark, linear, tmp_path):
    model = strategies.learn_offline(linear, L.LinearRegression(), ["x"], ["y"])
    assert strategies.evaluate_offline(model, linear, [M.MaxError()]).entries["LinearModel"]["MaxError"] < 1e-9
    model.save(f"{tmp_path}/m")
    assert rows(L.Model.load(f"{tmp_path}/m").predict(linear)) == rows(model.predict(linear))
    routed = L.ClusterLearner(L.LinearRegression(), "z").learn(linear, ["x", "z"], ["y"])
    assert M.MaxError().compute(routed.predict(linear), [("y", "y_predicted")]) < 1e-9


def test_trees_ensembles_and_persistence(spark, linear, tmp_path):
    ensemble = L.EnsembleLearner(L.regression_tree(2), L.regression_tree(3)).learn(linear, ["x"], ["y"])
    single = L.regression_tree(2).learn(linear, ["x"], ["y"])
    error = lambda m: M.MeanSquaredError("uniform_average").compute(m.predict(linear), [("y", "y_predicted")])
    assert error(ensemble) < error(single)
    single.save(f"{tmp_path}/tree")
    assert rows(L.MlModel.load(f"{tmp_path}/tree").predict(linear)) == rows(single.predict(linear))
    told = []

    class Told(L.Callbacks):
        def on_start(self, learner):
            told.append("start")

        def on_end(self, learner):
            told.append("end")

        def on_error(self, learner, error):
            told.append("error")

    classifier = L.classification_tree(3, threshold=0.5, callbacks=[Told()]).learn(linear, ["x", "z"], ["z"])
    assert M.Accuracy().compute(classifier.predict(linear), [("z", "z_predicted")]) == 1 and told == ["start", "end"]
    with pytest.raises(Exception):  # noqa: B017
        L.regression_tree(callbacks=[Told()]).learn(linear, ["nope"], ["y"])
    assert told[2:] == ["start", "error"]


def test_perceptron(linear):
    model = L.MlpLearner((16,), 120, 0.02).learn(linear, ["x"], ["y"])
    assert M.MeanAbsoluteError("uniform_average").compute(model.predict(linear), [("y", "y_predicted")]) < 0.1


def test_incremental_and_stream_agree(spark, linear, tmp_path):
    learner = L.IncrementalLinear(0.1)
    model = strategies.learn_incremental((linear.where(F.col("k") % 4 == i) for i in range(4)), learner, ["x"], ["y"])
    assert model.predict(linear).count() == 100
    with pytest.raises(ValueError):
        strategies.learn_incremental([], learner, ["x"], ["y"])
    linear.select("x", "y").coalesce(1).write.parquet(f"{tmp_path}/in")
    batch, stream = L.IncrementalLinear(0.1), L.IncrementalLinear(0.1)
    batch.learn(linear, ["x"], ["y"])
    source = spark.readStream.schema("x double, y double").parquet(f"{tmp_path}/in")
    assert learning.learn_stream(source, stream, ["x"], ["y"]) == 100
    assert np.allclose(batch.weights, stream.weights)
    learning.predict_stream(source, L.DummyModel(["x"], ["y"]), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 100


def test_active_loop():
    class Env:
        n = 0

        def observe(self):
            return self.n

        def act(self, action):
            self.last = action

        def step(self):
            self.n += 1
            if self.n > 3:
                raise Finished

    class Learner:
        def propose_action(self, seen):
            return -seen

        def learn_active(self, action, seen):
            return (action, seen)

        predict = propose_action

    assert strategies.learn_active(Env(), Learner()) == (-2, 3)
    assert strategies.evaluate_active(Env(), Learner(), [lambda o, a: (o, a)]) == {"<lambda>": ([1, 2, 3], [0, -1, -2])}


def test_stateful_selection(spark):
    df = spark.createDataFrame([(g, k, float(k), 0) for g in range(2) for k in range(5)], "g long, k long, v double, m long")
    out = learning.select_modes(df, "g", "k", ["v"], 1, "m", lambda samples, before: before[-1] + 1)
    assert [r["selected_mode"] for r in out.where("g = 1").orderBy("k").collect()] == [0, 1, 2, 3, 4]


def test_ode():
    t, x = ode.solve(lambda t, x: -x, 0.0, [1.0], 2.0)
    assert np.allclose(x[:, 0], np.exp(-t), atol=1e-6)
    system = ode.OdeSystem(lambda t, x: np.array([x[1], -x[0]]), 0.0, [0.0, 1.0])
    system.step(np.pi / 2)
    assert np.allclose(system.state, [1, 0], atol=1e-6)


def test_bouncing_ball(spark):
    trace = hybrid.simulate(hybrid.bouncing_ball(), (0.0, 2.0), [1.0, 0.0])
    assert trace.events[0].time == pytest.approx(np.sqrt(2 / 9.81), abs=1e-5)
    assert trace.events[0].state[1] == pytest.approx(0.8 * np.sqrt(2 * 9.81), abs=1e-4)
    starts = spark.createDataFrame([(k, [1.0 + k, 0.0]) for k in range(3)], "trace_id long, x0 array<double>")
    out = hybrid.generate_traces(hybrid.bouncing_ball, starts, (0.0, 1.0), 0.25, 2)
    assert out.count() == 15 and out.where("x0 < -1e-6").count() == 0
    with pytest.raises(RuntimeError):
        hybrid.simulate(hybrid.bouncing_ball(), (0.0, 50.0), [1.0, 0.0], max_jumps=5)


def test_modes(spark):
    df = spark.createDataFrame([(k, float(k % 17), (k % 17) * (2.0 if k < 60 else -1.0), float(k < 60)) for k in range(120)], "k long, x double, y double, s double")
    labelled, found = modes.identify_modes(df, "k", ["x"], "y", 20, 20, 1e-6)
    got = {r["k"]: r["mode"] for r in labelled.collect()}
    assert len(found) == 2 and {got[k] for k in range(1, 16)} == {0} and {got[k] for k in range(61, 67)} == {1}
    model = modes.learn_hybrid(df, "k", ["x"], "y", ["s"], start_width=20, step_width=20, threshold=1e-6)
    error = M.MaxError().compute(model.predict(df), [("y", "y_predicted")])
    assert error < 1e-6


def test_generators(spark):
    c = G.Continuous("a", 0.0, 1.0)
    assert len(c.to_discrete(0.25).values) == 5
    assert G.combinations(spark, c.to_discrete(0.5), G.Discrete("b", [1, 2]), G.Fixed("f", 7)).count() == 6
    with pytest.raises(ValueError):
        G.combinations(spark, G.Fixed("a", 1), G.Fixed("a", 2))
    some = G.stochastic(spark, 50, 3, c, G.Continuous("n", -1, 1, 0, 5))
    assert rows(some) == rows(G.stochastic(spark, 50, 3, c, G.Continuous("n", -1, 1, 0, 5))) and some.where("a < 0 or a > 1 or abs(n) > 1").count() == 0
    assert G.shares(10, [1, 1, 1]) == [4, 3, 3] and sum(G.shares(7, [0.2, 3, 5])) == 7


def test_intervals():
    a, b = G.Interval(0, 2), G.Interval(1, 3, low_open=True)
    assert (a & b) == G.Interval(1, 2, True, False) and 1 not in (a & b) and 2 in (a & b)
    assert (a & b) <= a and not a <= b and G.Interval(1, 1, True).empty


def test_tree_tests(spark, linear):
    out = G.tree_tests(linear.withColumn("s", (F.col("x") > 0.5).cast("double")), ["x"], "s", 40, 1)
    assert out.count() == 40 and {r["class"] for r in out.select("class").distinct().collect()} == {0, 1}
    assert G.tree_tests(linear, ["x"], "y", 0, 1, "boundary").count() == 12


def test_model_tests(linear):
    G.run_model_tests(L.DummyModel(["x"], ["y"]), linear, "y_predicted == 0")
    with pytest.raises(TestFailed) as e:
        G.run_model_tests(L.DummyModel(["x"], ["y"]), linear, "x < 0.5", stop_after=2)
    assert len(e.value.counterexamples) == 2
