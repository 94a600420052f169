"""Queries over learners, streams, simulation, mode identification and test generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalspan.ml import learners as L
from tidalspan.ml import strategies
from tidalspan.operators.series import SlidingWindow
from tidalspan.plans.common import EVENTS, events, rounded, scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", (F.col("l_returnflag") == "R").cast("double").alias("returned"))


@query("L01_linear_regression", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity * a + b, 2) AS predicted FROM lineitem, m")
def linear(spark, d):
    rows = _lines(spark, d)
    model = L.LinearRegression().learn(rows, ["l_quantity"], ["l_extendedprice"])
    return model.predict(rows).select("l_orderkey", "l_linenumber", F.round("l_extendedprice_predicted", 2).alias("predicted"))


def _tree(name: str, learner) -> None:
    def run(spark, d):
        rows = events(spark, d).select("event_id", "value", "t", (F.col("event_type") == "purchase").cast("double").alias("bought"))
        model = learner().learn(rows, ["value", "t"] if "classif" in name else ["t"], ["bought" if "classif" in name else "value"])
        out = model.predict(rows)
        return out.select("event_id", F.col(model.predictions[0]).alias("predicted"))

    QUERIES[name] = run


_tree("L02_regression_tree", lambda: L.regression_tree(4))
_tree("L03_random_forest", lambda: L.random_forest(5, 3))
_tree("L06_boosted_classifier", lambda: L.boosted_classifier(3, 2))
_tree("L06_boosted_regressor", lambda: L.boosted_regressor(3, 2))
_tree("L07_perceptron", lambda: L.MlpLearner((8,), epochs=2))


class _On(L.Learner):
    """Least squares on one of the inputs."""

    def __init__(self, feature: str) -> None:
        self.feature = feature

    def learn(self, df, inputs, outputs):
        return L.LinearRegression().learn(df, [self.feature], outputs)


@query("L12_ensemble", "WITH a AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem), r AS (SELECT *, s * l_quantity + i AS p, l_extendedprice - (s * l_quantity + i) AS rest FROM lineitem, a), b AS (SELECT regr_slope(rest, l_tax) AS s2, regr_intercept(rest, l_tax) AS i2 FROM r) SELECT l_orderkey, l_linenumber, round(p + s2 * l_tax + i2, 2) AS predicted FROM r, b")
def ensemble(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    model = L.EnsembleLearner(_On("l_quantity"), _On("l_tax")).learn(rows, ["l_quantity", "l_tax"], ["l_extendedprice"])
    return model.predict(rows).select("l_orderkey", "l_linenumber", F.round("l_extendedprice_predicted", 2).alias("predicted"))


@query("L13_cluster_models", "WITH m AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY l_returnflag) SELECT l_orderkey, l_linenumber, round(l_quantity * a + b, 2) AS predicted FROM lineitem JOIN m USING (l_returnflag)")
def cluster_models(spark, d):
    rows = _lines(spark, d)
    model = L.ClusterLearner(L.LinearRegression(), "l_returnflag").learn(rows, ["l_quantity"], ["l_extendedprice"])
    return model.predict(rows).select("l_orderkey", "l_linenumber", F.round("l_extendedprice_predicted", 2).alias("predicted"))


@query("L16_dummy", "SELECT event_id, 0.0::DOUBLE AS value_predicted FROM events")
def dummy(spark, d):
    return L.DummyLearner().learn(None, ["t"], ["value"]).predict(events(spark, d)).select("event_id", "value_predicted")


@query("L01_windowed_offline", f"WITH {EVENTS}, s AS (SELECT user_id, t, lag(value, 1) OVER w AS x, value AS y FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), k AS (SELECT * FROM s WHERE x IS NOT NULL), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k) SELECT user_id, t, round(a * x + b, 5) AS predicted FROM k, m")
def windowed(spark, d):
    window = SlidingWindow(2, "t", "user_id", ["value"])
    rows = events(spark, d)
    model = strategies.learn_offline(rows, L.LinearRegression(), ["value"], ["value_1"], window, ["value_0"])
    return model.predict(rows).select("user_id", "t", F.round("value_1_predicted", 5).alias("predicted"))


@query("X02_stream_learning", "SELECT f AS feature, round(2e-4 * v, 9) AS weight, n FROM (SELECT avg(value) AS a, avg(event_id % 7) AS b, count(*) AS n FROM events), LATERAL (VALUES ('value', a), ('k', b), ('', 1.0)) AS t(f, v)")
def stream_learning(spark, d):
    """One step from zero towards 1 for the one batch that the table is: the weights are known."""
    from tidalspan.streaming.learning import learn_stream

    learner = L.IncrementalLinear(1e-4)
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")
    seen = learn_stream(source.select("value", F.pmod(F.col("event_id"), F.lit(7)).cast("double").alias("k"), F.lit(1.0).alias("c")), learner, ["value", "k"], ["c"], checkpoint=scratch(spark, "learning"))
    rows = [(f, round(float(w), 9), seen) for f, w in zip(("value", "k", ""), learner.weights[:, 0], strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double, n long")


def _line(model_inputs, output, weights):
    return L.LinearModel(model_inputs, [output], {output: weights})


@query("X05_prediction_stream", "SELECT event_id, round(2.5 * value - 1, 6) AS value_predicted FROM events")
def prediction_stream(spark, d):
    from tidalspan.streaming.learning import predict_stream

    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")
    path = scratch(spark, "stream")
    predict_stream(source.select("event_id", "value"), _line(["value"], "value", [2.5, -1.0]), path)
    return spark.read.parquet(f"{path}/rows").select("event_id", rounded("value_predicted").alias("value_predicted"))


@query("X03_recording_window", f"WITH {EVENTS}, f AS (SELECT user_id, min(t) AS on_t FROM e WHERE event_type = 'purchase' GROUP BY user_id) SELECT e.event_id FROM e JOIN f USING (user_id) WHERE e.t >= f.on_t - 3600")
def recording_window(spark, d):
    from tidalspan.streaming.learning import recorded

    e = events(spark, d)
    return recorded(e.withColumn("on", F.col("event_type") == "purchase"), "user_id", "t", "on", 3600.0).select("event_id")


#: Heights and speeds of a ball between its impacts: the k-th at i, with upward speed v after it.
BALL = """
h AS (SELECT s_suppkey AS trace_id, ((s_suppkey % 7) + 1)::DOUBLE AS h FROM supplier), g AS (SELECT trace_id, unnest(range(0, 21))::INT AS step, h FROM h),
w AS (SELECT *, step * 0.1 AS t, sqrt(2 * h / 9.81) AS t1 FROM g),
p AS (SELECT *, list_filter(list_transform(range(0, 9), lambda k: t1 * (1 + 2 * (0.8 - pow(0.8, k + 1)) / 0.2)), lambda i: i <= t) AS impacts FROM w),
b AS (SELECT *, len(impacts) AS n, t - impacts[len(impacts)] AS since, pow(0.8, len(impacts)) * 9.81 * t1 AS v FROM p)
"""


@query("S17_batch_simulation", f"WITH {BALL} SELECT trace_id::BIGINT AS trace_id, step, 'fall' AS location, round(CASE WHEN n = 0 THEN h - 4.905 * t * t ELSE v * since - 4.905 * since * since END + 0.0003, 2) AS height, round(CASE WHEN n = 0 THEN -9.81 * t ELSE v - 9.81 * since END + 0.0003, 2) AS speed FROM b")
def batch_simulation(spark, d):
    from tidalspan.sim.hybrid import bouncing_ball, generate_traces

    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("trace_id"), F.array((F.pmod("s_suppkey", F.lit(7)) + 1).cast("double"), F.lit(0.0)).alias("x0"))
    out = generate_traces(bouncing_ball, starts, (0.0, 2.0), 0.1, 2)
    return out.select("trace_id", "step", "location", F.round(F.col("x0") + 0.0003, 2).alias("height"), F.round(F.col("x1") + 0.0003, 2).alias("speed"))


@query("S15_ode_source", "SELECT p_partkey::BIGINT AS trace_id, k::INT AS step, k * 0.25 AS t, round(p_size * exp(-0.125 * k), 3) AS x0 FROM part, range(0, 5) r(k)")
def ode_source(spark, d):
    from tidalspan.sim.ode import simulate_frame, vectorised

    starts = table(spark, d, "part").select(F.col("p_partkey").alias("trace_id"), F.array(F.col("p_size").cast("double")).alias("x0"))
    return simulate_frame(starts, vectorised(lambda t, x: -0.5 * x), (0.0, 1.0), 0.25, 1, rtol=1e-11, atol=1e-12).select("trace_id", "step", rounded("t").alias("t"), F.round("x0", 3).alias("x0"))


@query("L17_mode_identification", "SELECT p_partkey, (NOT (p_partkey % 1000 < 500 OR p_size * 2 = p_size * -3 + 10))::INT AS mode FROM part")
def mode_identification(spark, d):
    from tidalspan.sim.modes import identify_modes

    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.when(F.col("p_partkey") % 1000 < 500, F.col("p_size") * 2.0).otherwise(F.col("p_size") * -3.0 + 10).alias("y"))
    labelled, _ = identify_modes(rows, "p_partkey", ["x"], "y", start_width=100, step_width=200, threshold=1e-6, max_modes=4)
    return labelled.select("p_partkey", "mode")


@query("D08_model_tests", "SELECT l_orderkey, l_linenumber, round(0.5 * l_quantity + 1, 6) AS l_tax_predicted FROM lineitem WHERE NOT (0.5 * l_quantity + 1 <= 25 OR l_extendedprice < 60000)")
def model_tests(spark, d):
    from tidalspan.testing.generate import counterexamples

    found = counterexamples(_line(["l_quantity"], "l_tax", [0.5, 1.0]), _lines(spark, d), "l_tax_predicted <= 25 or l_extendedprice < 60000")
    return found.select("l_orderkey", "l_linenumber", rounded("l_tax_predicted").alias("l_tax_predicted"))


@query("D10_combinations", "SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM (SELECT unnest([0, 0.5, 1.0]) AS a), (SELECT unnest([1, 2]) AS b)")
def combinations(spark, d):
    from tidalspan.testing.generate import Continuous, Discrete, combinations

    return combinations(spark, Continuous("a", 0.0, 1.0).to_discrete(0.5), Discrete("b", [1.0, 2.0]))


@query("D11_stochastic")
def stochastic(spark, d):
    from tidalspan.testing.generate import Continuous, Discrete, stochastic

    return stochastic(spark, 1000, 7, Continuous("a", 0.0, 1.0), Discrete("b", [1.0, 2.0]))


@query("D12_tree_tests")
def tree_tests(spark, d):
    from tidalspan.testing.generate import tree_tests

    rows = _lines(spark, d).select("l_quantity", "l_extendedprice", "returned")
    return tree_tests(rows, ["l_quantity", "l_extendedprice"], "returned", 100, 3, "sampling")
