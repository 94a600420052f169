"""Queries over what a user writes or configures: protocols, persistence, selectors, loops, simulation."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalspan.ml import learners as L
from tidalspan.ml import metrics as M
from tidalspan.operators import fitted, series
from tidalspan.operators.base import Chain, Lambda, Transform
from tidalspan.plans.common import EVENTS, events, rounded, scratch, table, user_series

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- protocols


@query("F07_fit_chain", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 5) AS l_quantity FROM lineitem")
def fit_chain(spark, d):
    """A chain fits each part to what the parts before it give."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    numbers = rows.select("l_quantity")
    both = Chain(fitted.ScaleToRange(["l_quantity"]), fitted.Standardize()).fit(numbers)
    one = fitted.Standardize(both.parts[1].mean, both.parts[1].std)
    return one.apply(both.parts[0].apply(rows)).select("l_orderkey", "l_linenumber", rounded("l_quantity", 5).alias("l_quantity"))


class Halved(Transform):
    """A transform of a user's own, with an inverse."""

    def __init__(self, column: str, factor: float = 0.5) -> None:
        self.column, self.factor = column, factor

    def apply(self, df):
        return df.withColumn(self.column, F.col(self.column) * self.factor)

    def inverse(self):
        return Halved(self.column, 1 / self.factor)


@query("D01_own_transform", "SELECT ps.p_partkey, ps.p_size / 2.0 AS half, ps.p_size::DOUBLE AS back FROM part ps")
def own_transform(spark, d):
    half = Halved("half")
    rows = half(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("half")))
    return rows.withColumn("back", F.col("half")).transform((Halved("back").inverse() | Lambda(lambda df: df)).apply)


@query("D02_frame_lambda", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def frame_lambda(spark, d):
    return Lambda(lambda df: df.where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))).apply(table(spark, d, "orders"))


@query("D03_element_function", "SELECT c_custkey, length(c_name) * 2 + 1 AS n FROM customer")
def element_function(spark, d):
    """A function of one value, in Arrow batches."""
    @F.pandas_udf("long")
    def twice(names: pd.Series) -> pd.Series:
        return names.str.len() * 2 + 1

    return table(spark, d, "customer").select("c_custkey", twice("c_name").alias("n"))


@query("D04_table_function", "SELECT s_suppkey, upper(s_name) AS name, s_nationkey + 100 AS nation FROM supplier WHERE s_nationkey % 2 = 0")
def table_function(spark, d):
    """A function of tables, in batches; it may drop rows and change columns."""

    def run(frames):
        for f in frames:
            kept = f[f["s_nationkey"] % 2 == 0]
            yield kept.assign(name=kept["s_name"].str.upper(), nation=kept["s_nationkey"] + 100)[["s_suppkey", "name", "nation"]]

    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    kind = {f.name: f.dataType for f in rows.schema}
    return rows.mapInPandas(run, T.StructType([T.StructField("s_suppkey", kind["s_suppkey"]), T.StructField("name", T.StringType()), T.StructField("nation", kind["s_nationkey"])]))


class MeanLearner(L.Learner):
    """A learner of a user's own: the mean of each output."""

    def learn(self, df, inputs, outputs):
        row = df.agg(*(F.avg(f"`{o}`") for o in outputs)).first()
        return L.LinearModel(inputs, outputs, {o: [0.0] * len(inputs) + [row[k]] for k, o in enumerate(outputs)})


@query("D05_own_learner", "SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER (), 4) AS predicted FROM lineitem")
def own_learner(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = MeanLearner().learn(rows, ["l_quantity"], ["l_extendedprice"])
    return model.predict(rows).select("l_orderkey", "l_linenumber", rounded("l_extendedprice_predicted", 4).alias("predicted"))


@query("D06_callbacks", "SELECT * FROM (VALUES (0::BIGINT, 'start'), (1, 'progress 0.50'), (2, 'progress 1.00'), (3, 'end')) t(k, told)")
def callbacks(spark, d):
    told: list[str] = []

    class Kept(L.Callbacks):
        def on_start(self, learner):
            told.append("start")

        def on_progress(self, learner, done, metrics=None):
            told.append(f"progress {done:.2f}")

        def on_end(self, learner):
            told.append("end")

    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    L.MlpLearner((2,), epochs=2, callbacks=[Kept()]).learn(rows, ["x"], ["y"])
    return spark.createDataFrame(list(enumerate(told)), "k long, told string")


@query("D14_intervals", "SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_quantity <= 30) AS both, l_quantity BETWEEN 10 AND 30 AS closed FROM lineitem")
def intervals(spark, d):
    from tidalspan.testing.generate import Interval

    a, b = Interval(0.0, 30.0), Interval(10.0, 40.0, low_open=True)
    closed = Interval(10.0, 30.0)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    known = {float(r[0]) for r in rows.select("l_quantity").distinct().collect()}  # few values
    inside = lambda i: F.col("l_quantity").isin([v for v in known if v in i])
    return rows.select("l_orderkey", "l_linenumber", inside(a & b).alias("both"), inside(closed).alias("closed"))


@query("D15_settings", "SELECT * FROM (VALUES ('a', '1'), ('b.c', '20'), ('b.d', '3'), ('e', '40')) t(name, value)")
def settings(spark, d):
    from tidalspan import config

    found = config.merged({"a": 1, "b": {"c": 2, "d": 3}, "e": 4}, {"b": {"c": 20}}, None, {"e": 40})
    flat = [(k if not isinstance(v, dict) else f"{k}.{n}", str(w)) for k, v in found.items() for n, w in (v.items() if isinstance(v, dict) else [("", v)])]
    return spark.createDataFrame(flat, "name string, value string")


@query("D16_seeds", "SELECT true AS again, true AS other, 7::BIGINT AS seed")
def seeds(spark, d):
    import random

    from tidalspan import config

    draws = []
    for seed in (7, 7, 8):
        config.initialize_random(seed)
        draws.append(random.random())
    config.initialize_random(7)
    return spark.createDataFrame([(draws[0] == draws[1], draws[0] != draws[2], config.get_seed())], "again boolean, other boolean, seed long")


# --- models


@query("S26_saved_model", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity * a + b, 2) AS predicted FROM lineitem, m")
def saved_model(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    folder = scratch(spark, "model")
    spark.range(1).write.parquet(folder)
    L.LinearRegression().learn(rows, ["l_quantity"], ["l_extendedprice"]).save(f"{folder}/model.bin")
    return L.Model.load(f"{folder}/model.bin").predict(rows).select("l_orderkey", "l_linenumber", F.round("l_extendedprice_predicted", 2).alias("predicted"))


@query("L01_regression_on_times", "WITH x AS (SELECT event_id, epoch_us(ts) / 1e6 AS s, value FROM events), m AS (SELECT regr_slope(value, s - 1704067200) AS a, regr_intercept(value, s - 1704067200) AS b FROM x) SELECT event_id, round(a * (s - 1704067200) + b, 4) AS predicted FROM x, m")
def regression_on_times(spark, d):
    """Seconds since 1970 as input: far from zero, with all their digits."""
    rows = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "value")
    return L.LinearRegression().learn(rows, ["s"], ["value"]).predict(rows).select("event_id", rounded("value_predicted", 4).alias("predicted"))


STEP = "avg((w * x + b - y) * x) AS gw, avg(w * x + b - y) AS gb"


@query("L09_incremental_regression", f"WITH r AS (SELECT l_quantity / 50 AS x, l_tax AS y, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // (SELECT ceil(count(*) / 3.0)::BIGINT FROM lineitem) AS part FROM lineitem), g0 AS (SELECT {STEP} FROM (SELECT *, 0 AS w, 0 AS b FROM r WHERE part = 0)), w0 AS (SELECT -0.2 * gw AS w, -0.2 * gb AS b FROM g0), g1 AS (SELECT any_value(w) AS w, any_value(b) AS b, {STEP} FROM r, w0 WHERE part = 1), w1 AS (SELECT w - 0.2 * gw AS w, b - 0.2 * gb AS b FROM g1), g2 AS (SELECT any_value(w) AS w, any_value(b) AS b, {STEP} FROM r, w1 WHERE part = 2) SELECT round(w - 0.2 * gw, 9) AS weight, round(b - 0.2 * gb, 9) AS intercept FROM g2")
def incremental_regression(spark, d):
    """Three steps, one a batch."""
    from tidalspan.ml.strategies import learn_incremental
    from tidalspan.sources.frames import Batches

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), F.col("l_tax").alias("y"))
    model = learn_incremental(Batches(rows, ["l_orderkey", "l_linenumber"], -(-rows.count() // 3)), L.IncrementalLinear(0.1), ["x"], ["y"])
    return spark.createDataFrame([tuple(round(float(v), 9) for v in model.weights["y"])], "weight double, intercept double")


@query("L10_step_a_row", "WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, n_nationkey / 25 AS x, n_regionkey / 5 AS y FROM nation), s(k, w, b) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT s.k + 1, w - 0.2 * (w * x + b - y) * x, b - 0.2 * (w * x + b - y) FROM s JOIN r ON r.k = s.k + 1) SELECT round(w, 9) AS weight, round(b, 9) AS intercept FROM s ORDER BY k DESC LIMIT 1")
def step_a_row(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").select((F.col("n_nationkey") / 25).alias("x"), (F.col("n_regionkey") / 5).alias("y"))
    model = L.IncrementalLinear(0.1, per_row=True).learn(rows, ["x"], ["y"])
    return spark.createDataFrame([tuple(round(float(v), 9) for v in model.weights["y"])], "weight double, intercept double")


@query("L05_classifier", "SELECT n_nationkey, (n_regionkey >= 2)::DOUBLE AS high_predicted, (n_regionkey >= 2)::DOUBLE AS high_probability FROM nation")
def classifier(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_regionkey") >= 2).cast("double").alias("high"))
    model = L.classification_tree(3, threshold=0.5).learn(rows, ["n_regionkey"], ["high"])
    return model.predict(rows).select("n_nationkey", "high_predicted", "high_probability")


@query("L08_function_model", "SELECT event_id, round(sin(value) + value * value / 100, 5) AS y_predicted FROM events")
def function_model(spark, d):
    import numpy as np

    return L.NumpyModel(["value"], ["y"], lambda x: np.sin(x) + x * x / 100).predict(events(spark, d).select("event_id", "value")).select("event_id", rounded("y_predicted", 5).alias("y_predicted"))


def _nation_tree(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_regionkey") <= 1, 0).when(F.col("n_regionkey") <= 3, 1).otherwise(2).alias("mode"))
    return rows, L.classification_tree(3).learn(rows, ["n_regionkey"], ["mode"])


@query("L19_selector_details", "SELECT n_nationkey, CASE WHEN n_regionkey <= 1 THEN 0 WHEN n_regionkey <= 3 THEN 1 ELSE 2 END::DOUBLE AS selected_mode, 1.0::DOUBLE AS probability, CASE WHEN n_regionkey <= 1 THEN 0 WHEN n_regionkey <= 3 THEN 1 ELSE 2 END::DOUBLE AS leaf FROM nation")
def selector_details(spark, d):
    from tidalspan.sim.selector import details

    rows, tree = _nation_tree(spark, d)
    return details(tree, rows).select("n_nationkey", "selected_mode", F.array_max("mode_probabilities").alias("probability"), "leaf")


@query("L22_selector_nodes", "SELECT * FROM (VALUES (0::BIGINT, 'n_regionkey <= 1.5', NULL::DOUBLE), (1, NULL, 0), (2, 'n_regionkey <= 3.5', NULL), (3, NULL, 1), (4, NULL, 2)) t(node, condition, prediction)")
def selector_nodes(spark, d):
    from tidalspan.sim.selector import nodes

    _, tree = _nation_tree(spark, d)
    found = nodes(tree.models[0].toDebugString, tree.inputs)
    return spark.createDataFrame([(k, n["condition"], n["prediction"]) for k, n in enumerate(found)], "node long, condition string, prediction double")


@query("L21_selector_accuracy", f"WITH {EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e), a AS (SELECT round(avg(((value > 50) = (event_type = 'purchase'))::INT), 6) AS accuracy FROM k WHERE k > 1) SELECT kind, accuracy FROM a, (VALUES ('oracle'), ('autoregressive')) t(kind)")
def selector_accuracy(spark, d):
    from tidalspan.sim.selector import accuracies

    e = events(spark, d).select("event_id", "user_id", "value", (F.col("event_type") == "purchase").cast("long").alias("mode"))
    found = accuracies(e, "user_id", "event_id", ["value"], "mode", 1, lambda samples, before: int(samples[-1][0] > 50))
    return found.select("kind", rounded("accuracy").alias("accuracy"))


@query("L20_stream_selector", "SELECT event_id::DOUBLE AS t, (sum(CASE WHEN k = 1 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY k) % 3)::BIGINT AS selected_mode, k > 1 AS ready FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def stream_selector(spark, d):
    """The same selection with a bounded state on a stream."""
    from tidalspan.streaming.learning import select_modes_on_stream

    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")
    rows = raw.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("double").alias("t"), "value", F.lit(0).cast("long").alias("mode"))
    path = scratch(spark, "selected")
    out = select_modes_on_stream(rows, ["value"], 1, lambda samples, before: (before[-1] + (1 if samples[-1][0] > 50 else 2)) % 3)
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("t", "selected_mode", "ready")


@query("M12_selected_metric", "SELECT 'MaxError' AS metric, 'l_tax' AS feature, max(abs(l_tax - l_discount)) AS value FROM lineitem UNION ALL SELECT 'MeanAbsoluteError', 'l_tax', round(avg(abs(l_tax - l_discount)), 9) FROM lineitem")
def selected_metric(spark, d):
    """Metrics over one of several outputs."""
    rows = table(spark, d, "lineitem").select("l_tax", F.col("l_discount").alias("l_tax_predicted"), "l_quantity", F.lit(1.0).alias("l_quantity_predicted"))
    pairs = [("l_tax", "l_tax_predicted")]
    found = M.evaluate(rows, pairs, [M.MaxError("l_tax"), M.MeanAbsoluteError()])
    value = lambda v: v["l_tax"] if isinstance(v, dict) else v
    return spark.createDataFrame([(name.split("(")[0], "l_tax", round(float(value(v)), 9)) for name, v in found.items()], "metric string, feature string, value double")


# --- loops and streams


@query("X04_changes", f"WITH {EVENTS}, k AS (SELECT *, event_type = 'purchase' AS flag, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e) SELECT event_id, flag FROM k WHERE before IS NULL OR before <> flag")
def flag_changes(spark, d):
    from tidalspan.sources.frames import with_row_number
    from tidalspan.streaming.learning import changes

    e = events(spark, d).select("event_id", "user_id", "t", (F.col("event_type") == "purchase").alias("flag"))
    return changes(with_row_number(e, ["t", "event_id"], "k"), "user_id", "k", "flag").select("event_id", "flag")


class _Readings:
    """An active environment over the nations: a position that actions move."""

    def __init__(self, values: list[float]) -> None:
        self.values, self.at, self.moved = values, 0, 0.0

    def observe(self):
        from tidalspan.ml.strategies import Interface, Observation

        return Observation([Interface("value", self.values[self.at])], [Interface("reward", -abs(self.values[self.at] - self.moved))])

    def act(self, action):
        self.moved = action.actuators[0].value

    def step(self):
        from tidalspan.errors import Finished

        if self.at + 1 >= len(self.values):
            raise Finished
        self.at += 1


class _Follower:
    """Proposes what it saw last; learns the mean of what it sees."""

    def __init__(self) -> None:
        self.seen: list[float] = []

    def propose_action(self, seen):
        from tidalspan.ml.strategies import Action, Interface

        return Action([Interface("move", seen.sensors[0].value)])

    predict = propose_action

    def learn_active(self, action, seen):
        self.seen.append(seen.sensors[0].value)
        return self


def _values(spark, d) -> list[float]:
    return [float(r[0]) for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_regionkey").collect()]


@query("X07_active_loop", "SELECT count(*) AS n, round(avg(n_regionkey), 6) AS mean FROM nation WHERE n_nationkey > 0")
def active_loop(spark, d):
    from tidalspan.ml.strategies import learn_active

    seen = learn_active(_Readings(_values(spark, d)), _Follower()).seen
    return spark.createDataFrame([(len(seen), round(sum(seen) / len(seen), 6))], "n long, mean double")


@query("M13_active_metric", "WITH k AS (SELECT n_regionkey AS v, lag(n_regionkey) OVER (ORDER BY n_nationkey) AS before FROM nation) SELECT round(-avg(abs(v - before)), 6) AS mean_reward, count(*) AS n FROM k WHERE before IS NOT NULL")
def active_metric(spark, d):
    """Metrics over the lists of observations and actions."""
    from tidalspan.ml.strategies import evaluate_active

    def mean_reward(observations, actions):
        return sum(o.rewards[0].value for o in observations) / len(observations)

    def n(observations, actions):
        return len(actions)

    found = evaluate_active(_Readings(_values(spark, d)), _Follower(), [mean_reward, n])
    return spark.createDataFrame([(round(found["mean_reward"], 6), found["n"])], "mean_reward double, n long")


@query("S07_recordings", "SELECT 'region/' || n_regionkey AS topic, n_nationkey::DOUBLE AS time, n_nationkey * 2.0 + 1 AS x FROM nation")
def recordings(spark, d):
    """Messages by topic, through a reader of files of the caller's own."""
    from tidalspan.sources.recordings import read_messages

    path = scratch(spark, "messages")
    table(spark, d, "nation").select("n_nationkey", "n_regionkey").coalesce(1).write.json(path)
    (file,) = [r[0] for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()]

    def reader(uri):
        import json

        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(at) as lines:
            for line in lines.read().decode().splitlines():
                m = json.loads(line)
                yield f"region/{m['n_regionkey']}", float(m["n_nationkey"]), {"pose": {"x": m["n_nationkey"] * 2 + 1}}

    found = read_messages(spark, [file], {f"region/{k}": ["pose.x"] for k in range(5)}, reader)
    return found.select("topic", "time", F.col("values")["pose.x"].alias("x"))


# --- simulation


@query("S18_trace_columns", "SELECT s_suppkey::BIGINT AS trace_id, k::INT AS step, k * 0.5 AS t, 'on' AS location, round(s_nationkey + k * 0.5 * 3 + k * k * 0.125, 4) AS x, round(3 + k * 0.5, 4) AS dx_x, round(k * 0.5, 4) AS u_push FROM supplier, range(0, 5) r(k)")
def trace_columns(spark, d):
    """A system with an input: its trace with derivatives and inputs."""
    import numpy as np

    from tidalspan.sim.hybrid import HybridSystem, generate_runs

    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("trace_id"), F.array(F.col("s_nationkey").cast("double")).alias("x0"))
    system = lambda: HybridSystem({"on": lambda t, x, u: np.array([3.0 + u[0] * 1.0])}, [], "on")
    out = generate_runs(system, starts, (0.0, 2.0), ["x"], lambda: lambda t: [t], ["push"], derivatives=True, sample_dt=0.5)
    return out.select("trace_id", "step", "t", "location", *(rounded(c, 4).alias(c) for c in ("x", "dx_x", "u_push")))


@query("L18_simulated_model", "SELECT s_suppkey::BIGINT AS trace_id, k::INT AS step, 'mode_0' AS location, round((s_nationkey + 1) * exp(-0.25 * k) + 0.0003, 3) AS x FROM supplier, range(0, 5) r(k)")
def simulated_model(spark, d):
    """A learnt derivative, integrated from many starts."""
    from tidalspan.sim.modes import ModeModel

    rows = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x")).withColumn("dx", F.col("x") * -0.5)
    model = ModeModel(["x"], ["dx"], None, [L.LinearRegression().learn(rows, ["x"], ["dx"])], ["x"])
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("trace_id"), F.array((F.col("s_nationkey") + 1).cast("double")).alias("x0"))
    return model.simulate_frame(starts, (0.0, 2.0), 0.5).select("trace_id", "step", "location", F.round(F.col("x") + 0.0003, 3).alias("x"))


@query("R12_first_order", f"WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, t, value AS x, row_number() OVER w AS k, lag(value) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), c AS (SELECT user_id, tan(pi() * 1e-7 * (max(t) FILTER (WHERE k = 2) - max(t) FILTER (WHERE k = 1))) AS q FROM r GROUP BY user_id), y(user_id, k, t, v) AS (SELECT user_id, k, t, coalesce(q / (1 + q) * x, x) FROM r JOIN c USING (user_id) WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.t, q / (1 + q) * (r.x + r.before) - (q - 1) / (q + 1) * y.v FROM y JOIN r ON r.user_id = y.user_id AND r.k = y.k + 1 JOIN c ON c.user_id = y.user_id) SELECT user_id, t, round(v, 5) AS v FROM y")
def first_order(spark, d):
    """A filter of the first order, sample by sample."""
    out = series.SignalFilter("value", "lowpass", 1e-7, 1).apply(user_series(spark, d))
    return out.select("user_id", F.explode("value").alias("x")).select("user_id", F.col("x.time").alias("t"), rounded(F.col("x.value"), 5).alias("v"))


@query("R08_resample_cubic_exact", f"WITH {EVENTS}, s AS (SELECT user_id, min(t) AS a, max(t) AS b, floor(ceil(max(t) - min(t)) / 86400)::BIGINT AS m FROM e GROUP BY user_id HAVING count(*) >= 4), g AS (SELECT user_id, unnest(range(0, m + 1)) AS i, a, b, m FROM s), p AS (SELECT user_id, i, (CASE WHEN m = 0 THEN a ELSE a + i * (b - a) / m END) / 1e6 AS z FROM g) SELECT user_id, i::INT AS i, round(z * z * z - 2 * z * z + 0.5 + 0.00003, 4) AS v FROM p")
def resample_cubic_exact(spark, d):
    """Samples of a cubic, which a spline meets everywhere."""
    cubic = F.transform("value", lambda x: F.struct(x["time"].alias("time"), (F.pow(x["time"] / 1e6, F.lit(3.0)) - 2 * F.pow(x["time"] / 1e6, F.lit(2.0)) + 0.5).alias("value")))
    out = series.Resample(86400.0, "cubic").apply(user_series(spark, d).where(F.size("value") >= 4).withColumn("value", cubic))
    return out.select("user_id", F.posexplode("value").alias("i", "x")).select("user_id", "i", rounded(F.col("x.value") + 0.00003, 4).alias("v"))


@query("D13_resampled")
def resampled_rows(spark, d):
    from tidalspan.testing.surrogate import resampled

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return resampled(rows, ["l_quantity", "l_tax"], 1000, ["l_orderkey", "l_linenumber"], whole=["l_quantity"])


@query("D13_surrogate_tree", "SELECT count(*) AS n, true AS fits FROM lineitem")
def surrogate(spark, d):
    """A tree grown row by row tells a sharp cut on at least 95 of 100 rows."""
    from tidalspan.testing.surrogate import surrogate_tree

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", (F.col("l_quantity") > 25).cast("double").alias("high"))
    tree = surrogate_tree(rows, ["l_quantity", "l_tax"], "high", ["l_orderkey", "l_linenumber"], cuts=50)
    right = F.pandas_udf(lambda a, b, y: pd.Series(tree.predictions(pd.concat([a, b], axis=1).to_numpy(float)) == y), "boolean")("l_quantity", "l_tax", "high")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.avg(right.cast("double")) >= 0.95).alias("fits"))


# --- learners on what they must meet exactly


def _nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.element_at(F.array(*(F.lit(v) for v in (3.5, -1.0, 7.25, 0.0, 12.0))), (F.col("n_regionkey") + 1).cast("int")).alias("y"), (F.col("n_regionkey") >= 2).cast("double").alias("high"))


_EXACT = "SELECT n_nationkey, [3.5, -1.0, 7.25, 0.0, 12.0][n_regionkey + 1]::DOUBLE AS y_predicted FROM nation"
_HIGH = "SELECT n_nationkey, (n_regionkey >= 2)::DOUBLE AS high_predicted FROM nation"


def _exact(name: str, learner, output: str, sql: str) -> None:
    def run(spark, d):
        rows = _nations(spark, d)
        return learner().learn(rows, ["n_regionkey"], [output]).predict(rows).select("n_nationkey", rounded(f"{output}_predicted").alias(f"{output}_predicted"))

    QUERIES[name], SQL[name] = run, sql


_exact("L02_tree_of_levels", lambda: L.regression_tree(4), "y", _EXACT)
_exact("L06_boosted_levels", lambda: L.boosted_regressor(3, 4), "y", _EXACT)
_exact("L06_boosted_classes", lambda: L.boosted_classifier(3, 2), "high", _HIGH)


@query("L04_adaboost_classes", "SELECT n_nationkey, (n_regionkey >= 2)::BIGINT AS high_predicted FROM nation")
def adaboost_classes(spark, d):
    from tidalspan.ml.boosting import AdaBoost

    rows = _nations(spark, d)
    return AdaBoost(2).learn(rows, ["n_regionkey"], ["high"]).predict(rows).select("n_nationkey", F.col("high_predicted").cast("long").alias("high_predicted"))


@query("L03_forest_of_one_level", "SELECT n_nationkey, 4.5::DOUBLE AS y_predicted FROM nation")
def forest(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.lit(4.5).alias("y"))
    return L.random_forest(3, 2).learn(rows, ["n_regionkey"], ["y"]).predict(rows).select("n_nationkey", "y_predicted")


@query("F05_separated_clusters", "SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey >= 2) AS first FROM nation")
def clusters(spark, d):
    from pyspark.sql import Window as W

    from tidalspan.operators.fitted import Cluster

    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("double").alias("x"), "n_nationkey", F.when(F.col("n_regionkey") >= 2, 1000.0).otherwise(0.0).alias("side"))
    made = Cluster(2, features=["x", "side"]).fit(rows).apply(rows)
    label = next(c for c in made.columns if c not in rows.columns)
    return made.select("n_nationkey", F.min("n_nationkey").over(W.partitionBy(label)).alias("first"))


@query("M14_report", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem), e AS (SELECT l_extendedprice - (l_quantity * a + b) AS e FROM lineitem, m) SELECT 'LinearModel' AS model, 'MaxError' AS metric, round(max(abs(e)), 3) AS value FROM e UNION ALL SELECT 'LinearModel', 'MeanSquaredError', round(avg(e * e), 3) FROM e")
def report(spark, d):
    from tidalspan.ml.strategies import evaluate_offline

    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    model = L.LinearRegression().learn(rows, ["l_quantity"], ["l_extendedprice"])
    found = evaluate_offline(model, rows, [M.MaxError(), M.MeanSquaredError()])
    return spark.createDataFrame([(r[0], r[1].split("(")[0], round(float(r[-1]), 3)) for r in found.rows()], "model string, metric string, value double")


@query("D12_class_shares", "SELECT (n_regionkey > 1)::INT AS class, count(*) * 4 AS n, true AS inside FROM nation GROUP BY 1")
def class_shares(spark, d):
    """Tests shared among the classes of a tree by their rows, each inside its class."""
    from tidalspan.testing.generate import tree_tests

    rows = _nations(spark, d).select(F.col("n_regionkey").cast("double").alias("x"), (F.col("n_regionkey") > 1).cast("double").alias("side"))
    tests = tree_tests(rows, ["x"], "side", 100, 1)
    return tests.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("x") > 1.5) == (F.col("class") == 1)).alias("inside"))


@query("L02_one_tank")
def one_tank(spark, d):
    """The published example of learning times: a tank that a pump fills, 250 samples, windows of
    three, a tree of depth 4 on four fifths of them; its errors on the rest."""
    from tidalspan.ml.strategies import evaluate_offline, learn_offline

    train, test = tank_windows(spark)
    model = learn_offline(train, L.regression_tree(4), ["h_0", "h_1"], ["h_2"])
    found = evaluate_offline(model, test, [M.MeanAbsoluteError("uniform_average"), M.MeanSquaredError("uniform_average"), M.MaxError()])
    return spark.createDataFrame([(r[1].split("(")[0], float(r[-1])) for r in found.rows()], "metric string, value double")


def tank_windows(spark):
    """Train and test windows of the tank's level."""
    import numpy as np

    from tidalspan.sim.ode import OdeSystem
    from tidalspan.sources.frames import train_test_split

    # Fixed values of the example: area, outflow and inflow rates, the pump's period, the step.
    area, outflow, inflow, period, dt = 5.0, 0.5, 2.0, 10.0, 0.1
    tank = OdeSystem(lambda t, x: np.array([(inflow * max(0.0, np.sin(2 * np.pi * t / period)) - outflow * np.sqrt(x[0])) / area]), 0.0, np.array([1.0]))
    rows: list[tuple[float, float]] = []
    while len(rows) < 250:
        rows += [(float(t), float(x[0])) for t, x in zip(*tank.step(dt), strict=True)]
    frame = spark.createDataFrame([(0, *r) for r in rows[:250]], "trace int, t double, h double")
    windows = series.SlidingWindow(3, "t", "trace", ["h"]).apply(frame)
    return train_test_split(windows, 0.8, "t", shuffle=True, seed=42)
