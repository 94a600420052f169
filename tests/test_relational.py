import pickle

import pytest
from pyspark.sql import functions as F

from tidalspan.errors import FeatureNotFoundError, NoCategoriesError, NoMatchingCategoryError, NotFittedError
from tidalspan.functions.predicate import PredicateSyntaxError
from tidalspan.operators import fitted as P
from tidalspan.operators import relational as R
from tidalspan.operators.base import Chain, Identity, Lambda
from tidalspan.operators.joins import align, as_of, segments
from tidalspan.operators.statistics import density_clusters, enclosing_circle, kl_divergence


@pytest.fixture
def ab(spark):
    return spark.createDataFrame([(k, 6 - k) for k in range(1, 6)], "a long, b long")


def a_of(df):
    return sorted(r["a"] for r in df.collect())


def test_filters(ab):
    assert a_of(R.Filter("a > 2").apply(ab)) == [3, 4, 5]
    assert a_of(R.And(["(a > 2)", "b != 3"]).apply(ab)) == [4, 5]
    assert a_of(R.Or(["(a < 2)", "b < 2"]).apply(ab)) == [1, 5]
    assert a_of(R.And(["a > 2", R.Not(R.Or(["a == 4", "b == 2"]))]).apply(ab)) == [3, 5]
    assert a_of(R.And("a > 2").apply(ab)) == [3, 4, 5]
    assert a_of(R.Filter("1 < a <= 3 and not b == 4").apply(ab)) == [3]
    assert a_of(R.Filter("a ** 2 == 9 or abs(a - b) == 4").apply(ab)) == [1, 3, 5]


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "a[0]", "(lambda: 1)()", "c > 1", "a >", "a in (1, 2)"])
def test_filter_whitelist(ab, text):
    with pytest.raises(PredicateSyntaxError):
        R.Filter(text).apply(ab)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a long, b long, c long, afoo long, cbar long")
    assert R.Select(["a", "^c.*$"]).apply(df).columns == ["a", "c", "cbar"]
    assert R.Select("b").apply(df).columns == ["b"]
    assert R.Drop("a", "b").apply(df).columns == ["c", "afoo", "cbar"]
    assert R.Rename({"a": "x"}).apply(df).columns == ["x", "b", "c", "afoo", "cbar"]
    assert R.Rename({"a": "x"}).inverse().apply(R.Rename({"a": "x"}).apply(df)).columns == df.columns
    for wrong in (R.Drop("nope"), R.Rename({"nope": "x"}), R.Select("nope"), R.Cast({"nope": "int"})):
        with pytest.raises(FeatureNotFoundError):
            wrong.apply(df)


def test_cast(spark):
    df = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    kinds = lambda t: [k for _, k in t.apply(df).dtypes]
    assert kinds(R.Cast("double")) == ["double", "double"] and kinds(R.Cast("double", ["b"])) == ["bigint", "double"] and kinds(R.Cast({"a": "boolean"})) == ["boolean", "bigint"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.Cast("int").apply(spark.createDataFrame([("x",)], "s string")).collect()


def test_explode_and_unnest(spark):
    df = spark.createDataFrame([([1, 2], [3, 4], 7), ([], [], 8)], "t array<long>, a array<long>, c long")
    assert [tuple(r) for r in R.Explode(["t", "a"]).apply(df).collect()] == [(1, 3, 7), (2, 4, 7), (None, None, 8)]
    nested = spark.createDataFrame([((1, 2),)], "c struct<a:long,t:long>")
    assert R.Unnest("c").apply(nested).columns == ["a", "t"]
    s = spark.createDataFrame([([(0.0, (1.0, 2.0))], 5)], "s array<struct<time:double,value:struct<x:double,y:double>>>, k long")
    assert [tuple(r) for r in R.ExplodeTimeSeries("s").apply(s).collect()] == [(5, 0.0, 1.0, 2.0)]


def test_chain_fits_on_what_comes_before(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    chain = Lambda(lambda d: d.withColumn("a", F.col("a") * 2), lambda d: d.withColumn("a", F.col("a") / 2)) | P.ScaleToRange(["a"]) | Identity()
    out = chain.fit(df).apply(df)
    assert a_of(out) == [-1, 1] and a_of(chain.inverse().apply(out)) == [0, 10]
    assert len(Chain(chain, chain).parts) == 6
    assert a_of(pickle.loads(pickle.dumps(chain)).apply(df)) == [-1, 1]
    with pytest.raises(NotImplementedError):
        R.Filter("a > 1").inverse()


def test_scalers(spark):
    df = spark.createDataFrame([(0.0, 2.0, 5.0), (0.5, 3.0, 5.0), (1.0, 1.0, 5.0)], "a double, b double, k double")
    rows = P.ScaleToRange(["a", "b"]).fit(df).apply(df).collect()
    assert [tuple(r) for r in rows] == [(-1, 0, 5), (0, 1, 5), (1, -1, 5)]
    z = P.Standardize().fit(df)
    back = [tuple(round(v, 9) for v in r) for r in z.inverse().apply(z.apply(df)).collect()]
    assert back == [tuple(r) for r in df.collect()]  # also for the constant column
    assert [r["k"] for r in P.ScaleToRange(["k"]).fit(df).apply(df).collect()] == [-1, -1, -1]
    assert [r[0] for r in P.ScaleToRange.from_limits({"a": (2.0, 6.0)}).apply(spark.createDataFrame([(2.0,), (6.0,)], "a double")).collect()] == [-1, 1]
    for t in (P.Standardize(), P.ScaleToRange()):
        with pytest.raises(NotFittedError):
            t.apply(df)
        with pytest.raises(NotImplementedError):
            t.fit_incremental(df)


def test_encoders(spark):
    df = spark.createDataFrame([(1, 2), (4, 5), (7, 8), (10, 11)], "a long, b long")
    hot = P.OneHot.from_dataframe(df, ["a"]).apply(df)
    assert hot.columns == ["a_1", "a_4", "a_7", "a_10", "b"]
    assert [tuple(r)[:4] for r in hot.collect()] == [tuple(int(i == j) for j in range(4)) for i in range(4)]
    cold = P.OneCold({"a": [1, 7]}).apply(df)
    assert [tuple(r)[:2] for r in cold.collect()] == [(0, 1), (1, 1), (1, 0), (1, 1)]
    for kind in (P.OneHot, P.OneCold):
        with pytest.raises(NoMatchingCategoryError):
            kind({"a": [1, 7]}, True).apply(df)
        with pytest.raises(NoCategoriesError):
            kind({}).apply(df)
        assert kind({"a": [1, 4, 7, 10]}, True).apply(df).count() == 4


def test_cluster_keeps_columns(spark):
    df = spark.createDataFrame([(k, float(k > 5) * 100 + k) for k in range(10)], "id long, x double")
    out = P.Cluster(2, features=["x"]).fit(df).apply(df)
    assert out.columns == ["id", "x", "cluster_label"]
    labels = {r["id"]: r["cluster_label"] for r in out.collect()}
    assert len({labels[k] for k in range(6)}) == 1 and labels[0] != labels[9]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 9.0), (2, 1.0)], "k long, t double")
    right = spark.createDataFrame([(1, 3.0, "x"), (1, 5.0, "y")], "k long, t double, v string")
    got = lambda way: sorted((r["k"], r["t"], r["v"]) for r in as_of(left, right, ["k"], "t", ["v"], way).collect())
    assert got("forward") == [(1, 1, "x"), (1, 3, "x"), (1, 9, None), (2, 1, None)]
    assert got("backward") == [(1, 1, None), (1, 3, "x"), (1, 9, "y"), (2, 1, None)]


def test_align_and_segments(spark):
    a, b = spark.createDataFrame([(1, 1.0)], "k long, a double"), spark.createDataFrame([(2, 2.0)], "k long, b double")
    assert sorted(map(tuple, align([a, b], ["k"]).collect())) == [(1, 1.0, None), (2, None, 2.0)]
    flags = spark.createDataFrame([(0, k, k in (1, 2, 5)) for k in range(7)], "g long, t long, f boolean")
    assert sorted((r["segment"], r["start"], r["end"], r["n"]) for r in segments(flags, "f", ["g"], "t").collect()) == [(0, 1, 2, 2), (1, 5, 5, 1)]


def test_geometry():
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 2))
    x, y, r = enclosing_circle(points)
    d = np.hypot(points[:, 0] - x, points[:, 1] - y)
    assert d.max() <= r * (1 + 1e-9) and (d > r * (1 - 1e-9)).sum() >= 2
    assert enclosing_circle(np.array([[0.0, 0], [2, 0]]))[2] == 1
    labels = density_clusters(np.concatenate([rng.normal(0, 0.05, (20, 2)), rng.normal(5, 0.05, (20, 2)), [[99, 99]]]))
    assert labels[0] != labels[20] and set(labels[:20]) == {labels[0]} and labels[-1] == -1


def test_kl_divergence_orders_features(spark):
    df = spark.createDataFrame([(k % 2 == 0, float(k % 2), float(k % 3)) for k in range(60)], "y boolean, strong double, weak double")
    got = [r["feature"] for r in kl_divergence(df, "y", {"weak": 1.0, "strong": 1.0}).collect()]
    assert got == ["strong", "weak"]
    assert kl_divergence(df, "y", {"weak": 1.0, "strong": 1.0}, 1).count() == 1
