"""Queries over time series: the events of each user as one cell."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidalspan.operators import relational as R
from tidalspan.operators import series as T
from tidalspan.operators.joins import forward_fill
from tidalspan.plans.common import EVENTS, events, flat, rounded, table, user_series

QUERIES: dict = {}
SQL: dict[str, str] = {}

WEEK = 604800.0
#: Position of each sample in its user's series.
RANKED = f"{EVENTS}, s AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, lag(t) OVER w AS t0, lag(value) OVER w AS v0, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, value))"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("flagship_series_summary", f"WITH {EVENTS}, w AS (SELECT *, round(value) AS r FROM e WHERE t BETWEEN 0 AND {WEEK}), c AS (SELECT user_id, r, count(*) AS n FROM w GROUP BY user_id, r), m AS (SELECT user_id, max_by(r, (n, r)) AS value_mode FROM c GROUP BY user_id) SELECT w.user_id, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, any_value(value_mode) AS value_mode, round(arg_min(value, t), 6) AS value_first, round(arg_max(value, t), 6) AS value_last FROM w JOIN m USING (user_id) GROUP BY w.user_id")
def summary(spark, d):
    s = T.TimeWindow("value", 0.0, WEEK).apply(user_series(spark, d)).where(F.size("value") > 0)
    coarse = s.withColumn("r", F.transform("value", lambda x: F.struct(x["time"].alias("time"), F.round(x["value"]).alias("value"))))
    out = (T.Mean("value") | T.Median("value") | T.First("value") | T.Last("value")).apply(coarse)
    out = T.Mode("r").apply(out)
    return out.select("user_id", *(rounded(c).alias(c) for c in ("value_mean", "value_median")), F.col("r_mode").alias("value_mode"), *(rounded(c).alias(c) for c in ("value_first", "value_last")))


@query("R01_to_time_series", f"WITH {EVENTS} SELECT user_id, t, round(value, 6) AS v FROM e")
def to_series(spark, d):
    return flat(user_series(spark, d), "value", "user_id")


@query("R01_whole_frame", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS i, n_nationkey::BIGINT AS t, n_regionkey::BIGINT AS v FROM nation")
def whole_frame(spark, d):
    s = T.ToTimeSeries("n_nationkey").apply(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    return s.select(F.posexplode("n_regionkey").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.col("x.time").cast("long").alias("t"), F.col("x.value").cast("long").alias("v"))


def _flat_lines(spark, d, change=None):
    """l_orderkey, k, v: all lines of each order by one pass, as columns as many as the longest has, that
    change alters, and as rows again. The longest is found without making the series."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = T.ToTimeSeries({"l_quantity": "l_linenumber"}, keys="l_orderkey").apply(lines).withColumn("n", F.size("l_quantity"))
    flat = T.Flatten("l_quantity", padded=True)
    flat.lengths = {"l_quantity": lines.groupBy("l_orderkey").count().agg(F.max("count")).first()[0] or 0}
    wide, prefix = flat.apply(orders), "l_quantity_derivative" if change else "l_quantity"
    values = F.array(*(F.col(f"{prefix}_{k}") for k in range(flat.lengths["l_quantity"]))).cast("array<double>")
    return (change.apply(wide) if change else wide).select("l_orderkey", F.posexplode(F.slice(values, F.lit(1), F.col("n"))).alias("k", "v"))


@query("R02_flatten", "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1)::INT AS k, l_quantity AS v FROM lineitem")
def flatten(spark, d):
    return _flat_lines(spark, d)


@query("R03_sliding_window", f"WITH {EVENTS}, s AS (SELECT user_id, t, lag(value, 2) OVER w AS value_0, lag(value, 1) OVER w AS value_1, value AS value_2, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, value_0, value_1, value_2 FROM s WHERE k >= 3")
def sliding_window(spark, d):
    return T.SlidingWindow(3, "t", "user_id", ["value"]).apply(events(spark, d))


@query("R04_series_windows", f"WITH {RANKED} SELECT user_id, t, round(value, 6) AS v, round(v2, 6) AS v2 FROM s WHERE k < n AND (k - 1) % 2 = 0")
def series_windows(spark, d):
    w = T.TimeSeriesSlidingWindow(2, "value", stride=2).apply(user_series(spark, d))
    return w.select("user_id", F.col("value")[0]["time"].alias("t"), rounded(F.col("value")[0]["value"]).alias("v"), rounded(F.col("value")[1]["value"]).alias("v2"))


@query("R05_slice_series", f"WITH {EVENTS}, k AS (SELECT *, (t > 86400)::INT + (t > {WEEK})::INT AS part FROM e) SELECT user_id, count(*) AS n, round(min(t), 6) AS t0, round(max(t), 6) AS t1 FROM k GROUP BY user_id, part")
def slice_series(spark, d):
    s = user_series(spark, d).withColumn("points", F.array(F.lit(86400.0), F.lit(WEEK), F.lit(-1.0)))
    parts = T.SliceTimeSeries("value", "points").apply(s)
    return parts.select("user_id", F.size("value").cast("long").alias("n"), rounded(F.array_min("value.time")).alias("t0"), rounded(F.array_max("value.time")).alias("t1"))


@query("R06_time_window", f"WITH {EVENTS} SELECT user_id, t, round(value, 6) AS v FROM e WHERE t BETWEEN 1000 AND 200000")
def time_window(spark, d):
    return flat(T.TimeWindow("value", 1000.0, 200000.0).apply(user_series(spark, d)), "value", "user_id")


@query("R07_pad", f"WITH {RANKED}, x AS (SELECT user_id, t, value FROM s UNION ALL SELECT user_id, 2500000.0, value FROM s WHERE k = n AND t < 2500000) SELECT user_id, count(*) AS n, round(max(t), 6) AS t1, round(arg_max(value, t), 6) AS last FROM x GROUP BY user_id")
def pad(spark, d):
    p = T.Pad(2500000.0, "value").apply(user_series(spark, d))
    return p.select("user_id", F.size("value").cast("long").alias("n"), rounded(F.array_max("value.time")).alias("t1"), rounded(F.element_at("value", -1)["value"]).alias("last"))


HOUR_GRID = f"{EVENTS}, b AS (SELECT user_id, min(t) AS a, max(t) AS z, floor(ceil(max(t) - min(t)) / 86400.0)::INT AS m FROM e GROUP BY user_id), g AS (SELECT user_id, i, CASE WHEN i = m THEN z ELSE a + i * (z - a) / m END AS gt FROM b, LATERAL (SELECT unnest(range(0, m + 1)) AS i))"


@query("R08_resample_linear", f"WITH {HOUR_GRID}, p AS (SELECT g.user_id, g.i, g.gt, l.t AS t0, l.value AS v0, r.t AS t1, r.value AS v1 FROM g ASOF JOIN e l ON g.user_id = l.user_id AND g.gt >= l.t ASOF JOIN e r ON g.user_id = r.user_id AND g.gt <= r.t) SELECT user_id, i::BIGINT AS i, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (gt - t0) * (v1 - v0) / (t1 - t0) END, 4) AS v FROM p")
def resample(spark, d):
    r = T.Resample(86400.0).apply(user_series(spark, d))
    return r.select("user_id", F.posexplode("value").alias("i", "x")).select("user_id", F.col("i").cast("long").alias("i"), rounded(F.col("x.value"), 4).alias("v"))


@query("R08_resample_cubic")
def resample_cubic(spark, d):
    r = T.Resample(86400.0, "cubic").apply(user_series(spark, d))
    return r.select("user_id", F.posexplode("value").alias("i", "x")).select("user_id", "i", rounded(F.col("x.value"), 4).alias("v"))


def _pair(spark, d):
    """user_id with the series a (clicks) and b (purchases)."""
    e = events(spark, d)
    a, b = (T.ToTimeSeries({"value": "t"}, "user_id").apply(e.where(F.col("event_type") == k)).withColumnRenamed("value", n) for k, n in (("click", "a"), ("purchase", "b")))
    return a.join(b, "user_id")


PAIR = f"{EVENTS}, u AS (SELECT user_id FROM e WHERE event_type IN ('click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 2), x AS (SELECT e.* FROM e JOIN u USING (user_id) WHERE event_type IN ('click', 'purchase'))"


@query("R09_match_sampling_rate", f"WITH {PAIR}, g AS (SELECT *, row_number() OVER w AS p, CASE WHEN event_type = 'purchase' THEN value END AS b FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t)), h AS (SELECT *, last_value(b IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN b IS NOT NULL THEN p END IGNORE NULLS) OVER w AS p0, first_value(b IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN b IS NOT NULL THEN p END IGNORE NULLS) OVER z AS p1 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, t, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 6) AS v FROM h WHERE event_type = 'click'")
def match_sampling_rate(spark, d):
    return flat(T.MatchSamplingRate("a", {"b": "linear"}).apply(_pair(spark, d)), "b", "user_id")


@query("R09_match_by_time", f"WITH {PAIR}, c AS (SELECT * FROM x WHERE event_type = 'click'), p AS (SELECT * FROM x WHERE event_type = 'purchase'), j AS (SELECT c.user_id, c.t, l.t AS t0, l.value AS v0, r.t AS t1, r.value AS v1 FROM c ASOF LEFT JOIN p l ON c.user_id = l.user_id AND c.t >= l.t ASOF LEFT JOIN p r ON c.user_id = r.user_id AND c.t <= r.t) SELECT user_id, t, round(CASE WHEN v0 IS NULL OR v1 IS NULL THEN 0 WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM j")
def match_by_time(spark, d):
    return flat(T.MatchSamplingRate("a", {"b": "linear"}, "zero", by="time").apply(_pair(spark, d)), "b", "user_id")


@query("R10_zero_order_hold", f"WITH {PAIR}, h AS (SELECT user_id, t, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS b FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT user_id, t, round(a, 6) AS a, round(b, 6) AS b FROM h WHERE a IS NOT NULL AND b IS NOT NULL")
def zero_order_hold(spark, d):
    z = T.ZeroOrderHold(["a", "b"]).apply(_pair(spark, d))
    return R.ExplodeTimeSeries("aligned").apply(z).where(F.col("time").isNotNull()).select("user_id", F.col("time").alias("t"), rounded("a").alias("a"), rounded("b").alias("b"))


for _method, _sql in (
    ("forward", "SELECT user_id, t, round((v2 - value) / (t2 - t), 6) AS v FROM s WHERE t2 IS NOT NULL"),
    ("backward", "SELECT user_id, t, round((value - v0) / (t - t0), 6) AS v FROM s WHERE t0 IS NOT NULL"),
    ("central", "SELECT user_id, t, round((v2 - v0) / (t2 - t0), 6) AS v FROM s WHERE t0 IS NOT NULL AND t2 IS NOT NULL"),
):
    QUERIES[f"R11_derivative_{_method}"] = lambda spark, d, m=_method: flat(T.DiscreteDerivative("value", m).apply(user_series(spark, d)), "value_derivative", "user_id")
    SQL[f"R11_derivative_{_method}"] = f"WITH {RANKED} {_sql}"


@query("R12_signal_filter")
def signal_filter(spark, d):
    grid = T.Resample(3600.0).apply(user_series(spark, d))
    return flat(T.SignalFilter("value", "lowpass", 1 / 36000).apply(grid), "value", "user_id")


@query("R13_detect_rises", f"WITH {RANKED} SELECT user_id, t2 AS t FROM s WHERE v2 > value")
def detect_rises(spark, d):
    return T.DetectDelocalizations("value", "at", None).apply(user_series(spark, d)).select("user_id", F.explode("at").alias("t"))


@query("R14_localization_status", f"WITH {EVENTS} SELECT event_id, round(sqrt(power(value - t / 1000, 2) + power(1, 2)), 6) AS position_error, sqrt(power(value - t / 1000, 2) + power(1, 2)) > 100 AS is_delocalized FROM e")
def localization_status(spark, d):
    pose = lambda x, y: F.struct(F.struct(x.alias("x"), F.lit(y).alias("y")).alias("position"), F.struct(*(F.lit(float(k == "w")).alias(k) for k in "xyzw")).alias("orientation"))
    e = events(spark, d)
    s = e.select("event_id", F.array(F.struct(F.col("t").alias("time"), F.struct(pose(F.col("value"), 1.0).alias("truth"), pose(F.col("t") / 1000, 2.0).alias("estimate")).alias("value"))).alias("poses"))
    out = T.LocalizationStatus("poses", 100.0, 0.5).apply(s)
    return out.select("event_id", rounded(F.col("poses")[0]["value"]["position_error"]).alias("position_error"), F.col("poses")[0]["value"]["is_delocalized"].alias("is_delocalized"))


@query("R15_flat_derivative", "SELECT l_orderkey, (row_number() OVER w - 1)::INT AS k, round(l_quantity - lag(l_quantity, 1, l_quantity) OVER w, 6) AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)")
def flat_derivative(spark, d):
    return _flat_lines(spark, d, T.FlatDerivative("l_quantity")).select("l_orderkey", "k", rounded("v").alias("v"))


@query("P13_explode_series", f"WITH {EVENTS} SELECT user_id, t AS time, value FROM e")
def explode_series(spark, d):
    return R.ExplodeTimeSeries("value").apply(user_series(spark, d))


@query("P14_collapse", f"WITH {RANKED} SELECT user_id, value FROM s WHERE k = 1")
def collapse(spark, d):
    return R.Collapse("value").apply(user_series(spark, d))


for _name, _class, _sql in (
    ("A01_mean", T.Mean, "round(avg(value), 6)"), ("A02_median", T.Median, "round(median(value), 6)"),
    ("A04_first", T.First, "round(arg_min(value, t), 6)"), ("A05_last", T.Last, "round(arg_max(value, t), 6)"),
):
    QUERIES[_name] = lambda spark, d, c=_class: c("value", replace=True).apply(user_series(spark, d)).select("user_id", rounded("value").alias("value"))
    SQL[_name] = f"WITH {EVENTS} SELECT user_id, {_sql} AS value FROM e GROUP BY user_id"


@query("A03_mode", f"WITH {EVENTS}, c AS (SELECT user_id, floor(value / 20) AS b, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, max_by(b, (n, b))::BIGINT AS value_mode FROM c GROUP BY user_id")
def mode(spark, d):
    s = T.ToTimeSeries({"value": "t"}, "user_id").apply(events(spark, d).withColumn("value", F.floor(F.col("value") / 20)))
    return T.Mode("value").apply(s).select("user_id", "value_mode")


@query("W02_difference", f"WITH {RANKED} SELECT event_id, round(value - v0, 6) AS d FROM s")
def difference(spark, d):
    w = W.partitionBy("user_id").orderBy("t", "value")
    return events(spark, d).select("event_id", rounded(F.col("value") - F.lag("value").over(w)).alias("d"))


@query("W04_forward_fill", f"WITH {EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM e")
def filled(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return forward_fill(e, ["v"], ["user_id"], ["t"]).select("event_id", "v")


@query("W08_history_features", f"WITH {EVENTS}, h AS (SELECT event_id, value, lag(value, 1) OVER w AS value_t_minus_1, lag(event_type, 1) OVER w AS event_type_t_minus_1, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, value, value_t_minus_1, event_type_t_minus_1 FROM h WHERE k > 1")
def history(spark, d):
    from tidalspan.sim.modes import history_features

    made = history_features(events(spark, d), ["value"], ["event_type"], 1, "user_id", "t")
    return made.select("event_id", "value", "value_t_minus_1", "event_type_t_minus_1")
