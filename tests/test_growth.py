"""Steps whose work must grow no faster than their input."""

import numpy as np
import pandas as pd

import pytest

from tidalspan.ml import learners as L
from tidalspan.operators import kernels
from tidalspan.operators.series import Resample
from tidalspan.plans import more, series
from tidalspan.sim import modes, ode
from tidalspan.streaming import learning, retention
from tidalspan.testing import surrogate


@pytest.fixture
def small_frames(spark):
    """Spark hands a key's rows to Python three at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _streamed(spark, folder, rows, schema, made):
    """What a query over a stream gives for rows that come in no order, in one micro-batch."""
    mixed = [rows[k] for k in np.random.default_rng(1).permutation(len(rows))]
    spark.createDataFrame(mixed, schema).coalesce(1).write.parquet(f"{folder}/in")
    out = made(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def test_recorder_orders_rows_over_frames(spark, tmp_path, small_frames):
    rows = [(key, float(t), 0.0, t in (20, 33)) for key in range(3) for t in range(40)]
    out = _streamed(spark, tmp_path, rows, retention.SCHEMA, lambda s: retention.record(s, 5.0))
    assert sorted((r["key"], r["t"]) for r in out.collect()) == [(key, float(t)) for key in range(3) for t in range(15, 40)]


class _Stepwise(L.LinearRegression):
    """Least squares for which no window is passed over."""


def test_windows_that_must_fit_are_not_tried(spark, monkeypatch):
    fits, learn = [], L.LinearRegression.learn
    monkeypatch.setattr(L.LinearRegression, "learn", lambda self, *a: fits.append(1) or learn(self, *a))
    df = spark.range(2000).selectExpr("id AS k", "double(id % 17) AS x", "double(id % 17) * 2 AS y")
    labelled, found = modes.identify_modes(df, "k", ["x"], "y", 20, 20, 1e-6)
    assert len(found) == 1 and labelled.where("mode = 0").count() == 2000
    assert len(fits) < 30  # one for each of 100 windows before


def test_windows_passed_over_change_nothing(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 300)
    y = np.where(np.arange(300) < 170, 2 * x, 5 - x) + rng.uniform(-0.05, 0.05, 300)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(300), "x": x, "y": y}))
    for threshold in (0.06, 0.4):
        made = [modes.identify_modes(df, "k", ["x"], "y", 20, 20, threshold, learner, 3) for learner in (None, _Stepwise())]
        assert made[0][0].orderBy("k").collect() == made[1][0].orderBy("k").collect()
        assert [m.weights for m in made[0][1]] == [m.weights for m in made[1][1]]


def test_stream_selector_orders_rows_over_frames(spark, tmp_path, small_frames):
    schema, decide = "key long, t double, value double, mode long", lambda samples, before: (before[-1] + int(samples[-1][0])) % 5
    rows = [(key, float(t), float(t % 3), 0) for key in range(3) for t in range(40)]
    out = _streamed(spark, tmp_path, rows, schema, lambda s: learning.select_modes_on_stream(s, ["value"], 1, decide))
    want = [(float(t), sum(k % 3 for k in range(1, t + 1)) % 5, t > 0) for t in range(40)]
    got = sorted((r["key"], r["t"], r["selected_mode"], r["ready"]) for r in out.collect())
    assert got == [(key, *w) for key in range(3) for w in want]


def test_tree_grows_where_the_rows_are(spark, monkeypatch):
    """The tree of blocks ahead is that of the rows one after another; none comes to the driver."""
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(1, 51, 20000).astype(float), rng.integers(0, 9, 20000) / 100])
    y = ((x[:, 0] > 25) ^ (rng.random(20000) < 0.05)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(20000), "a": x[:, 0], "b": x[:, 1], "y": y}))
    monkeypatch.setattr(surrogate, "BLOCK", 700)
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **b: pytest.fail("rows come to the driver"))
    tree = surrogate.surrogate_tree(df, ["a", "b"], "y", "k", cuts=20)
    want = surrogate.HoeffdingTree(2, cuts=20).learn(zip(x, y, strict=True))
    assert len(want.classes()) > 3 and tree.classes() == want.classes()
    assert [leaf.seen for leaf, _ in tree.leaves()] == [leaf.seen for leaf, _ in want.leaves()]
    assert tree.predictions(x[:500]).tolist() == [tree.predict(a) for a in x[:500]]


def test_batches_are_summed_up_together(spark, tmp_path):
    """X01 runs no job for each of its 40 batches."""
    spark.range(100_000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 9 AS user_id", "'click' AS event_type", "double(id % 10) AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.sparkContext.setJobGroup("bounded", "X01")
    found = more.QUERIES["X01_bounded_batches"](spark, str(tmp_path)).orderBy("batch").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bounded")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in found] == [(k, 2500, 2500 * k, 9.0) for k in range(40)]
    assert 0 < len(jobs) < 20


def test_traces_of_many_starts_are_those_of_each(spark):
    """A vectorised flow is called for many starts at once, and each keeps its own steps."""
    x0 = np.array([[1.0, 0.0], [3.0, -2.0], [0.0, 0.0], [250.0, 40.0]]).T
    flow = lambda t, x: np.array([x[1], -4 * x[0] - 0.1 * x[1] + np.sin(t)])
    at, calls = np.linspace(0, 3, 7), []
    many = ode.sampled(lambda t, x: calls.append(1) or flow(t, x), at, x0, 3.0)
    for k in range(4):
        want, n = [x0[:, k]], 1
        for s in ode.steps(flow, 0.0, x0[:, k], 3.0):
            while n < len(at) and at[n] <= s.t1:
                want.append(s.at(at[n]))
                n += 1
        assert np.allclose(many[:, :, k], want, rtol=1e-12, atol=1e-12)
    starts = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(300)], "trace_id long, x0 array<double>")
    alone, together = (ode.simulate_frame(starts, f, (0.0, 1.0), 0.3, 2).orderBy("trace_id", "step").toPandas() for f in (flow, ode.vectorised(lambda t, x: flow(t, x))))
    assert len(alone) == 1500 and np.allclose(alone, together, rtol=1e-12, atol=1e-12)


def test_flow_that_explodes_is_refused():
    with pytest.raises(ArithmeticError):
        ode.sampled(lambda t, x: x * x, np.array([0.0, 2.0]), np.array([[0.1, 1.0]]), 2.0)


#: Orders of one to five lines.
LINES = [(k, n, float((7 * k + 3 * n) % 11)) for k in range(50) for n in range(k % 5 + 1)]


@pytest.fixture
def lines(spark, tmp_path):
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_orders_of_any_length_are_flattened_in_one_pass(spark, lines):
    out = series.QUERIES["R02_flatten"](spark, lines)
    assert sorted(map(tuple, out.collect())) == sorted(LINES) and _passes(out) == 1


def test_orders_of_any_length_are_derived_in_one_pass(spark, lines):
    out, at = series.QUERIES["R15_flat_derivative"](spark, lines), {r[:2]: r[2] for r in LINES}
    assert sorted(map(tuple, out.collect())) == sorted((k, n, v - at.get((k, n - 1), v)) for k, n, v in LINES) and _passes(out) == 1


def test_models_are_integrated_from_many_starts_at_once(spark):
    """A table of starts in one file is dealt out, and the flow is called for many of them."""
    flow = L.NumpyModel(["v", "x", "t"], ["dx", "dv"], lambda rows: np.column_stack([rows[:, 0], -rows[:, 1] + rows[:, 2]]))
    model = modes.ModeModel(["v", "x", "t"], ["dx", "dv"], None, [flow], ["x", "v"])
    starts = spark.createDataFrame([(k, [k / 10, 1.0 - k]) for k in range(40)], "trace_id long, x0 array<double>").coalesce(1)
    frame = model.simulate_frame(starts, (0.0, 1.0), 0.25)
    assert frame.rdd.getNumPartitions() > 1
    found = frame.orderBy("trace_id", "step").toPandas()
    for k in (0, 7, 39):
        trace = model.simulate((0.0, 1.0), [k / 10, 1.0 - k], sample_dt=0.25)
        own = found[found["trace_id"] == k]
        assert np.allclose(own[["x", "v"]], trace.x, rtol=1e-12, atol=1e-12) and own["t"].tolist() == trace.t.tolist() and own["location"].tolist() == trace.location


def test_perceptron_of_many_rows_takes_its_steps_in_tasks(spark, monkeypatch):
    """Every row once an epoch, in tasks; no row comes to the driver."""
    monkeypatch.setattr(L, "SENT", 1000)
    monkeypatch.setattr(L, "TASK", 2)
    frame = spark.range(1000).selectExpr("double(id) / 1000 AS x", "3 * double(id) / 1000 - 1 AS y")
    monkeypatch.setattr(type(frame), "toLocalIterator", lambda *a, **b: pytest.fail("rows come to the driver"))
    learner = L.MlpLearner((8,), epochs=20, rate=0.02, batch=8, held=100)
    model, again = (learner.learn(frame, ["x"], ["y"]) for _ in range(2))
    x = np.linspace(0, 1, 50)[:, None]
    assert np.abs(model.function(x) - (3 * x - 1)).max() < 0.1 and (model.function(x) == again.function(x)).all()
    parts = learner._parts(frame, 1, 1000)
    rows = [np.frombuffer(r["block"], np.float64).reshape(-1, 2) for r in parts.collect()]
    assert parts.getNumPartitions() == 5 and np.sort(np.concatenate(rows)[:, 0]).tolist() == [k / 1000 for k in range(1000)]


def test_series_are_read_and_made_in_pieces(spark, monkeypatch):
    """However many series a batch holds, about SAMPLES samples are made before they go; rows stay whole."""
    rows = [(k, None if k % 10 == 3 else [(0.0, float(k)), (5.0, 2.0), (1000.0 * (k % 4), 1.0)][: 3 if k % 4 else 0]) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, value array<struct<time: double, value: double>>").coalesce(1)
    want = {r["k"]: r["value"] for r in Resample(1.0).apply(df).collect()}
    kept, given = [], df.toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
    monkeypatch.setattr(kernels, "SAMPLES", 10_000)
    Resample(1.0).apply(df)
    made = list(kept[0](iter(given)))
    assert len(given) == 1 and len(made) > 10 and max(len(b.column("value").values) for b in made) <= 10_000 + 3001
    got = {r["k"]: r["value"] for b in made for r in b.to_pylist()}
    assert got.keys() == want.keys() and all((v is None) == (want[k] is None) and (v is None or [(x["time"], x["value"]) for x in v] == [tuple(x) for x in want[k]]) for k, v in got.items())
    assert [p.num_rows for p in kernels.pieces(given[0], ["value"])] == [200]
