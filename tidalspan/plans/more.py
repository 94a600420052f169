"""Queries over windows, limits, further models, streams and tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidalspan.ml import learners as L
from tidalspan.ml import metrics as M
from tidalspan.operators import series as T
from tidalspan.plans.common import EVENTS, events, rounded, scratch, table
from tidalspan.sources import frames as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("S12_prediction_batches", f"WITH {EVENTS} SELECT event_id, round(3 * value + 2, 6) AS value_predicted, ((row_number() OVER (ORDER BY event_id) - 1) // 4000)::BIGINT AS batch FROM e")
def prediction_batches(spark, d):
    """What the environment is told, batch by batch."""
    env, model = S.DatasetPrediction(events(spark, d).select("event_id", "value"), "event_id", 4000), L.LinearModel(["value"], ["value"], {"value": [3.0, 2.0]})
    for batch in env:
        env.act(model.predict(batch))
    told = [a.select("event_id", rounded("value_predicted").alias("value_predicted"), F.lit(k).cast("long").alias("batch")) for k, a in enumerate(env.actions)]
    return S.collect(told)


@query("S23_frame_adapter", "SELECT n_nationkey::BIGINT AS n_nationkey, 2.0 * n_nationkey + 0.5 AS x_predicted FROM nation")
def frame_adapter(spark, d):
    from tidalspan.ml.strategies import prediction_loop

    adapter = S.FrameAdapter(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")), "n_nationkey")
    prediction_loop(L.LinearModel(["n_nationkey"], ["x"], {"x": [2.0, 0.5]}), adapter)
    return spark.createDataFrame(adapter.results, "n_nationkey long, x_predicted double")


@query("S25_test_case_sink", "SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM (SELECT unnest([0, 0.5, 1.0]) AS a), (SELECT unnest([1, 2]) AS b)")
def test_case_sink(spark, d):
    from tidalspan.testing.generate import Continuous, Discrete, combinations, save_csv

    path = scratch(spark, "cases")
    save_csv(combinations(spark, Continuous("a", 0.0, 1.0).to_discrete(0.5), Discrete("b", [1.0, 2.0])), path)
    return S.read_csv(spark, path, schema="a double, b double")


@query("A09_row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return spark.range(1).select(F.lit(len(S.Environment(table(spark, d, "lineitem")))).cast("long").alias("n"))


@query("A11_all_rows", "SELECT bool_and(o_orderstatus IN ('F', 'O', 'P')) AS known, bool_or(o_totalprice > 400000) AS high FROM orders")
def all_rows(spark, d):
    return table(spark, d, "orders").agg(F.bool_and(F.col("o_orderstatus").isin("F", "O", "P")).alias("known"), F.bool_or(F.col("o_totalprice") > 400000).alias("high"))


def _user():
    return W.partitionBy("user_id").orderBy("t", "value")


@query("W01_lag", f"WITH {EVENTS} SELECT event_id, lag(value, 3) OVER (PARTITION BY user_id ORDER BY t, value) AS before FROM e")
def lagged(spark, d):
    return events(spark, d).select("event_id", F.lag("value", 3).over(_user()).alias("before"))


@query("W03_central_difference", f"WITH {EVENTS} SELECT event_id, round(lead(value) OVER w - lag(value) OVER w, 6) AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, value)")
def central(spark, d):
    return events(spark, d).select("event_id", rounded(F.lead("value").over(_user()) - F.lag("value").over(_user())).alias("d"))


@query("W05_row_number", f"WITH {EVENTS} SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY t, value) - 1)::BIGINT AS k FROM e")
def numbered(spark, d):
    return events(spark, d).select("event_id", (F.row_number().over(_user()) - 1).cast("long").alias("k"))


@query("W10_row_index", f"WITH {EVENTS} SELECT event_id, (row_number() OVER (ORDER BY t, event_id))::BIGINT AS k FROM e")
def row_index(spark, d):
    return S.with_row_number(events(spark, d).select("event_id", "t"), ["t", "event_id"], "k").select("event_id", F.col("k").cast("long").alias("k"))


@query("O01_sorted_series", f"WITH {EVENTS} SELECT user_id, round(min(value), 6) AS low, round(max(value), 6) AS high FROM e GROUP BY user_id")
def sorted_series(spark, d):
    from tidalspan.plans.common import user_series

    s = user_series(spark, d).withColumn("v", F.array_sort("value.value"))
    return s.select("user_id", rounded(F.get("v", F.lit(0))).alias("low"), rounded(F.element_at("v", -1)).alias("high"))


@query("O02_slice", f"WITH {EVENTS}, n AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) AS k FROM e) SELECT event_id FROM n WHERE k BETWEEN 101 AND 150")
def sliced(spark, d):
    rows = S.with_row_number(events(spark, d).select("event_id", "t"), ["t", "event_id"], "k")
    return rows.where("k between 101 and 150").select("event_id")


@query("U01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return S.collect([table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))])


@query("W07_fill_strategies", f"WITH {EVENTS} SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, max(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY user_id)) AS v FROM e")
def fills(spark, d):
    e = events(spark, d).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", F.coalesce("p", F.max("p").over(W.partitionBy("user_id"))).alias("v"))


@query("M02_classification_report")
def classification_report(spark, d):
    text = M.ClassificationReport().compute(table(spark, d, "labels"), [("quality", "toxic")])
    return spark.createDataFrame([(line,) for line in text.strip("\n").split("\n")], "line string")


@query("M15_tune_threshold", "WITH t AS (SELECT i, round(0.05 * i, 2) AS threshold FROM range(1, 20) r(i)), x AS (SELECT l_returnflag = 'R' AS y, l_quantity / 50 AS p FROM lineitem), s AS (SELECT threshold, 2.0 * count(*) FILTER (WHERE p >= threshold AND y) / nullif(2 * count(*) FILTER (WHERE p >= threshold AND y) + count(*) FILTER (WHERE p < threshold AND y) + count(*) FILTER (WHERE p >= threshold AND NOT y), 0) AS f FROM t, x GROUP BY threshold) SELECT threshold::DOUBLE AS threshold, round(f, 6) AS score FROM s ORDER BY f DESC, threshold LIMIT 1")
def tuned(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    threshold, score = M.tune_threshold(rows, "y", "p")
    return spark.createDataFrame([(threshold, round(score, 6))], "threshold double, score double")


@query("L04_adaboost")
def adaboost(spark, d):
    from tidalspan.ml.boosting import AdaBoost

    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") > 40000).cast("long").alias("high"))
    return AdaBoost(3).learn(rows, ["l_quantity", "l_extendedprice"], ["high"]).predict(rows).groupBy("high", "high_predicted").agg(F.count(F.lit(1)).alias("n"))


@query("L14_mealy_words", "SELECT s::INT AS state, i::VARCHAR AS symbol, ((s + i) % 2)::INT AS target, ((s + i) % 2)::VARCHAR AS output FROM range(0, 2) a(s), range(0, 2) b(i)")
def mealy(spark, d):
    from tidalspan.ml.automata import learn_mealy

    machine = learn_mealy(([k % 2, k // 2 % 2, k // 4 % 2], [k % 2, (k + k // 2) % 2, (k + k // 2 + k // 4) % 2]) for k in range(8))
    return spark.createDataFrame([(s, str(i), t, str(o)) for s, step in enumerate(machine.delta) for i, (t, o) in step.items()], "state int, symbol string, target int, output string")


@query("X06_stateful_selection", f"WITH {EVENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e) SELECT event_id, (sum(CASE WHEN k = 1 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY k) % 3)::BIGINT AS selected_mode FROM s")
def stateful(spark, d):
    """A mode that follows from the one selected before and from the present value."""
    from tidalspan.streaming.learning import select_modes

    e = events(spark, d).select("event_id", "user_id", F.struct("t", "event_id").alias("at"), "value", F.lit(0).alias("mode"))
    e = S.with_row_number(e.select("event_id", "user_id", "value", "mode", F.col("at.t").alias("t")), ["t", "event_id"], "k")
    chosen = select_modes(e, "user_id", "k", ["value"], 1, "mode", lambda samples, before: (before[-1] + (1 if samples[-1][0] > 50 else 2)) % 3)
    return chosen.select("event_id", "selected_mode")


@query("X03_stream_recorder", f"WITH {EVENTS}, f AS (SELECT user_id, min(t) AS on_t FROM e WHERE event_type = 'purchase' GROUP BY user_id) SELECT e.user_id AS key, count(*) AS n FROM e JOIN f USING (user_id) WHERE e.t >= f.on_t - 3600 GROUP BY 1")
def stream_recorder(spark, d):
    from tidalspan.streaming.retention import record

    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")
    t = ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("t")
    path = scratch(spark, "recorded")
    rows = record(raw.select(F.col("user_id").alias("key"), t, "value", (F.col("event_type") == "purchase").alias("flag")), 3600.0)
    rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("X01_bounded_batches", f"WITH {EVENTS}, r AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 2500 AS batch FROM e) SELECT batch::BIGINT AS batch, count(*) AS n, min(event_id) AS first, round(max(value), 6) AS high FROM r GROUP BY 1")
def bounded(spark, d):
    batches = S.Batches(events(spark, d).select("event_id", "value"), "event_id", 2500)
    return batches.aggregated(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), rounded(F.max("value")).alias("high"))


@query("D09_domains")
def domains(spark, d):
    from tidalspan.testing.generate import Continuous, Fixed, stochastic

    return stochastic(spark, 500, 3, Continuous("u", -1.0, 1.0), Continuous("n", -3.0, 3.0, 0.0, 1.0), Fixed("f", 7.0))


@query("S16_hybrid_simulation", "SELECT k AS event, round(sqrt(4 / 9.81) * (1 + 2 * (0.8 - pow(0.8, k + 1)) / 0.2), 3) AS time, 'fall' AS source, 'fall' AS target, round(pow(0.8, k + 1) * sqrt(4 * 9.81), 3) AS speed FROM range(0, 3) r(k)")
def hybrid(spark, d):
    from tidalspan.sim.hybrid import bouncing_ball, simulate

    trace = simulate(bouncing_ball(), (0.0, 3.0), [2.0, 0.0], rtol=1e-10, atol=1e-12)
    return spark.createDataFrame([(k, round(float(e.time), 3), e.source, e.target, round(float(e.state[1]), 3)) for k, e in enumerate(trace.events)], "event long, time double, source string, target string, speed double")


@query("L18_hybrid_model", "SELECT s_suppkey, (s_suppkey % 100 >= 50)::INT AS selected_mode, CASE WHEN s_suppkey % 100 < 50 THEN 2.0 * s_nationkey ELSE 5.0 - s_nationkey END AS y_predicted FROM supplier")
def hybrid_model(spark, d):
    from tidalspan.sim.modes import learn_hybrid

    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 100 < 50).cast("double").alias("side"))
    rows = rows.withColumn("y", F.when(F.col("side") == 1, F.col("x") * 2).otherwise(5 - F.col("x")))
    model = learn_hybrid(rows, "s_suppkey", ["x"], "y", ["side"], start_width=5, step_width=20, threshold=1e-6, max_modes=3)
    return model.predict(rows).select("s_suppkey", "selected_mode", F.round("y_predicted", 6).alias("y_predicted"))


@query("R01_keyed_lengths", f"WITH {EVENTS} SELECT user_id, event_type, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def keyed_lengths(spark, d):
    s = T.ToTimeSeries({"value": "t"}, ["user_id", "event_type"]).apply(events(spark, d))
    return s.select("user_id", "event_type", F.size("value").cast("long").alias("n"))
