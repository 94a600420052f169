"""Queries over fitted transforms, aggregates and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalspan.ml import metrics as M
from tidalspan.operators import fitted as P
from tidalspan.operators import statistics as A
from tidalspan.plans.common import EVENTS, events, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


NUMBERS = ["l_quantity", "l_extendedprice"]


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*NUMBERS)


@query("F01_standardize", "SELECT round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 5) AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 5) AS l_extendedprice FROM lineitem")
def standardize(spark, d):
    rows = _lines(spark, d)
    return P.Standardize().fit(rows).apply(rows).select(*(rounded(c, 5).alias(c) for c in NUMBERS))


@query("F01_standardize_inverse", "SELECT round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem")
def standardize_inverse(spark, d):
    rows = _lines(spark, d)
    z = P.Standardize().fit(rows)
    return z.inverse().apply(z.apply(rows)).select(*(rounded(c, 4).alias(c) for c in NUMBERS))


@query("F02_scale_to_range", "SELECT round(-1 + 2 * (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem")
def scale(spark, d):
    rows = _lines(spark, d)
    return P.ScaleToRange(["l_quantity"]).fit(rows).apply(rows).select(*(rounded(c).alias(c) for c in NUMBERS))


@query("F02_scale_from_limits", "SELECT round((l_quantity - 1) / 49, 6) AS l_quantity FROM lineitem")
def scale_from_limits(spark, d):
    return P.ScaleToRange.from_limits({"l_quantity": (1.0, 50.0)}, 0.0, 1.0).apply(_lines(spark, d)).select(rounded("l_quantity").alias("l_quantity"))


@query("F03_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::BIGINT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::BIGINT AS \"o_orderstatus_P\" FROM orders")
def one_hot(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return P.OneHot({"o_orderstatus": ["F", "O", "P"]}).apply(rows)


@query("F03_one_hot_fitted", "SELECT c_custkey, c_mktsegment AS segment, 1::BIGINT AS flag FROM customer")
def one_hot_fitted(spark, d):
    """The name of the one flag that is set, and the flag."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    made = P.OneHot.from_dataframe(rows, ["c_mktsegment"], True).apply(rows)
    flags = [c for c in made.columns if c.startswith("c_mktsegment_")]
    each = F.array(*(F.struct(F.lit(c.removeprefix("c_mktsegment_")).alias("segment"), F.col(f"`{c}`").cast("long").alias("flag")) for c in flags))
    return made.select("c_custkey", F.explode(each).alias("x")).select("c_custkey", "x.*").where("flag <> 0")


@query("F04_one_cold", "SELECT o_orderkey, (o_orderstatus <> 'F')::BIGINT AS \"o_orderstatus_F\", (o_orderstatus <> 'O')::BIGINT AS \"o_orderstatus_O\" FROM orders")
def one_cold(spark, d):
    return P.OneCold({"o_orderstatus": ["F", "O"]}).apply(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


@query("F05_cluster")
def cluster(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return P.Cluster(3, features=["c_acctbal"]).fit(rows).apply(rows)


@query("A06_global_min_max", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem")
def min_max(spark, d):
    return _lines(spark, d).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), rounded(F.avg("l_quantity")).alias("mean"), rounded(F.stddev_samp("l_quantity")).alias("std"))


@query("A08_distinct", "SELECT DISTINCT event_type FROM events")
def distinct(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


@query("A10_collect_list", f"WITH {EVENTS} SELECT user_id, event_type, count(*) AS n, round(min(t), 6) AS t0 FROM e GROUP BY user_id, event_type")
def collect_list(spark, d):
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("x"))
    return g.select("user_id", "event_type", F.size("x").cast("long").alias("n"), rounded(F.get("x", F.lit(0))["t"]).alias("t0"))


@query("A12_confusion_matrix", "SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, d):
    return A.confusion_matrix(table(spark, d, "labels"), "quality", "toxic")


@query("A13_compare_traces", "SELECT 'value' AS state, round(avg(abs(value - round(value, 0))), 6) AS mae, round(sqrt(avg(power(value - round(value, 0), 2))), 6) AS rmse, round(max(abs(value - round(value, 0))), 6) AS max_error FROM events")
def compare(spark, d):
    e = events(spark, d).select("event_id", "value")
    return A.compare_traces(e, e.withColumn("value", F.round("value", 0)), ["event_id"], ["value"]).select("state", *(rounded(c).alias(c) for c in ("mae", "rmse", "max_error")))


@query("A14_kl_divergence", "WITH x AS (SELECT l_returnflag = 'R' AS y, floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / 5.0) AS b FROM lineitem), c AS (SELECT b, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM x GROUP BY b), s AS (SELECT p / (SELECT sum(p) FROM c) + 1e-10 AS p, q / (SELECT sum(q) FROM c) + 1e-10 AS q FROM c) SELECT 'l_quantity' AS feature, round(sum(p * ln(p / q)), 6) AS divergence FROM s")
def divergence(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", F.col("l_returnflag") == "R")
    return A.kl_divergence(rows, "y", {"l_quantity": 5.0}).select("feature", rounded("divergence").alias("divergence"))


@query("A15_particle_cloud")
def cloud(spark, d):
    points = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((F.col("t") / 86400).alias("x"), (F.col("value") / 10).alias("y")))).alias("cloud"))
    return A.particle_cloud_statistics(points, "cloud", ["user_id"])


LABELS = [("quality", "toxic")]


def _metric(name: str, made, sql: str) -> None:
    def run(spark, d):
        return table(spark, d, "labels").agg(rounded(made().expressions(LABELS)[""]).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn, avg((quality = toxic)::INT) AS acc FROM labels) SELECT round({sql}, 6) AS value FROM c"


_metric("M01_accuracy", M.Accuracy, "acc")
_metric("M03_f_beta", lambda: M.FBetaScore(2.0), "5.0 * tp / (5.0 * tp + 4.0 * fn + fp)")
_metric("M04_precision", M.PrecisionScore, "tp / (tp + fp)")
_metric("M05_recall", M.Recall, "tp / (tp + fn)")

PAIR = [("l_extendedprice", "guess")]


def _guess(spark, d):
    return table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("guess"))


def _regression(name: str, metric: M.Metric, sql: str, places: int = 5) -> None:
    def run(spark, d):
        found = metric.expressions(PAIR)
        return _guess(spark, d).agg(rounded(next(iter(found.values())), places).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"WITH x AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS d FROM lineitem) SELECT round({sql}, {places}) AS value FROM x"


_regression("M06_max_error", M.MaxError(), "max(abs(d))")
_regression("M07_mean_absolute_error", M.MeanAbsoluteError(), "avg(abs(d))")
_regression("M08_mean_absolute_percentage_error", M.MeanAbsolutePercentageError(), "avg(abs(d) / greatest(abs(y), 2.220446049250313e-16))")
_regression("M09_mean_squared_error", M.MeanSquaredError(), "avg(d * d)", 0)
_regression("M10_r2", M.R2Score(), "1 - sum(d * d) / (var_pop(y) * count(y))")
_regression("M11_mean_euclidean_distance", M.MeanEuclideanDistance(), "avg(sqrt(d * d))")


@query("M14_report")
def report(spark, d):
    found = M.evaluate(_guess(spark, d), PAIR, [M.MaxError(), M.MeanAbsoluteError(), M.R2Score()])
    return M.Report({"guess": found}).to_frame(spark)


@query("M15_threshold_scores", "WITH t AS (SELECT 0.25 * i AS threshold FROM range(1, 4) r(i)), x AS (SELECT l_returnflag = 'R' AS y, l_quantity / 50 AS p FROM lineitem) SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE p >= threshold AND y) AS tp, count(*) FILTER (WHERE p >= threshold AND NOT y) AS fp, count(*) FILTER (WHERE p < threshold AND y) AS fn, count(*) FILTER (WHERE p < threshold AND NOT y) AS tn FROM t, x GROUP BY threshold")
def thresholds(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return M.threshold_scores(rows, "y", "p", [0.25, 0.5, 0.75])
