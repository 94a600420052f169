import math

import numpy as np
import pytest

from tidalspan import types
from tidalspan.errors import FeatureLengthVaryError, FeatureNotFoundError, NoTimeSeriesFeatureError
from tidalspan.operators import series as S
from tidalspan.operators.kernels import cubic

TS = "array<struct<time:double,value:double>>"


def frame(spark, *cells, columns=("a",), kind=TS):
    """One row a tuple of cells; a cell is a list of (time, value)."""
    rows = [tuple(c if isinstance(c, list | type(None)) else c for c in row) for row in cells]
    return spark.createDataFrame(rows, ", ".join(f"{c} {kind if isinstance(kind, str) else kind[k]}" for k, c in enumerate(columns)))


def cells(df, column):
    return [None if r[column] is None else [(x["time"], x["value"]) for x in r[column]] for r in df.collect()]


A = [[(0.0, 1.0), (1.0, 2.0), (1.5, 3.0)], [(0.0, 0.0), (5.0, 5.0), (15.0, 25.0)]]


@pytest.mark.parametrize(("method", "want"), [
    ("forward", [[(0, 1), (1, 2)], [(0, 1), (5, 2)]]),
    ("backward", [[(1, 1), (1.5, 2)], [(5, 1), (15, 2)]]),
    ("central", [[(1, 2 / 1.5)], [(5, 25 / 15)]]),
])
def test_derivative(spark, method, want):
    df = frame(spark, *[(a,) for a in A])
    assert cells(S.DiscreteDerivative("a", method).apply(df), "a_derivative") == want


def test_derivative_of_empty_null_and_single(spark):
    df = frame(spark, ([],), (None,), ([(1.0, 1.0)],))
    assert cells(S.DiscreteDerivative("a", "forward").apply(df), "a_derivative") == [[], None, []]
    with pytest.raises(ValueError):
        S.DiscreteDerivative("a", "sideways")


def test_resample(spark):
    df = frame(spark, ([(0.0, 1.0), (2.0, 2.0)], 1), ([(0.0, 0.0), (3.0, 3.0)], 2), columns=("a", "n"), kind=(TS, "long"))
    assert cells(S.Resample(1.0).apply(df), "a") == [[(0, 1), (1, 1.5), (2, 2)], [(0, 0), (1, 1), (2, 2), (3, 3)]]
    assert cells(S.Resample(1).apply(frame(spark, ([],), (None,))), "a") == [[], None]
    # the grid's step is the period only where that divides the span
    assert cells(S.Resample(1.0).apply(frame(spark, ([(0.0, 0.0), (1.5, 1.5)],))), "a") == [[(0, 0), (0.75, 0.75), (1.5, 1.5)]]
    with pytest.raises(ValueError):
        S.Resample(1.0, "quintic")


def test_resample_per_feature(spark):
    df = frame(spark, ([(0.0, 1.0), (2.0, 2.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), columns=("a", "b"))
    out = S.Resample({"a": 1.0, "b": 2.0}).apply(df)
    assert cells(out, "a") == [[(0, 1), (1, 1.5), (2, 2)]] and cells(out, "b") == [[(0, 0), (2, 2)]]


def test_cubic_reproduces_a_cubic():
    x = np.array([0.0, 1, 2.5, 3, 5])
    f = lambda t: t**3 - 2 * t
    at = np.linspace(0, 5, 21)
    assert np.allclose(cubic(x, f(x), at), f(at))
    assert np.allclose(cubic(x[:3], x[:3] ** 2, at[:5]), at[:5] ** 2)
    assert np.allclose(cubic(x[:2], x[:2], at), at)


def test_time_window(spark):
    df = frame(spark, ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)],), ([(0.0, 0.0), (2.0, 2.0), (5.0, 5.0)],), ([(-1.0, 0.0)],))
    assert cells(S.TimeWindow("a", 1, 2).apply(df), "a") == [[(1, 1), (2, 2)], [(2, 2)], []]
    assert cells(S.TimeWindow().apply(df), "a")[2] == []  # negative times are outside by default


def test_flatten(spark):
    df = frame(spark, ([(0.0, 1.0), (1.0, 2.0)], [(0.0, 5.0), (1.0, 6.0)], 1), ([(0.0, 3.0), (1.0, 4.0)], [(0.0, 7.0), (1.0, 8.0)], 2), columns=("a", "b", "n"), kind=(TS, TS, "long"))
    out = S.Flatten().apply(df)
    assert out.columns == ["a_0", "a_1", "b_0", "b_1", "n"]
    assert [tuple(r) for r in out.collect()] == [(1, 2, 5, 6, 1), (3, 4, 7, 8, 2)]
    with pytest.raises(NoTimeSeriesFeatureError):
        S.Flatten(["n"]).apply(df)
    with pytest.raises(FeatureLengthVaryError):
        S.Flatten().apply(frame(spark, ([(0.0, 1.0)],), ([(0.0, 1.0), (1.0, 1.0)],)))


def test_pad(spark):
    df = frame(spark, ([(0.0, 42.0), (1.0, 43.0)],), ([(2.0, 44.0), (6.0, 46.0)],), ([],), (None,))
    assert cells(S.Pad(5.0).apply(df), "a") == [[(0, 42), (1, 43), (5, 43)], [(2, 44), (6, 46)], [], None]


@pytest.mark.parametrize(("kind", "want"), [
    (S.Mean, [128 / 3, 1 / 3, None, None]), (S.Median, [43, 0, None, None]), (S.Mode, [43, 0, None, None]), (S.First, [42, 0, None, None]), (S.Last, [43, 0, None, None]),
])
def test_summaries(spark, kind, want):
    df = frame(spark, ([(0.0, 42.0), (1.0, 43.0), (2.0, 43.0)],), ([(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)],), ([],), (None,))
    got = [r[f"a_{kind.name}"] for r in kind("a").apply(df).collect()]
    assert got == pytest.approx(want) if None not in want else [g is None if w is None else math.isclose(g, w) for g, w in zip(got, want, strict=True)] == [True] * 4
    assert kind("a", replace=True).apply(df).columns == ["a"]


def test_mode_of_a_tie_is_the_greatest(spark):
    df = frame(spark, ([(0.0, 42.0), (1.0, 42.0), (2.0, 43.0), (3.0, 43.0)],))
    assert S.Mode("a").apply(df).first()["a_mode"] == 43


def test_series_windows(spark):
    a = lambda *v: [(float(k), float(x)) for k, x in enumerate(v)]
    values = lambda df, c="a": [[x["value"] for x in r[c]] for r in df.collect()]
    assert values(S.TimeSeriesSlidingWindow(2).apply(frame(spark, (a(42, 43, 44),), (a(17, 16, 15),)))) == [[42, 43], [43, 44], [17, 16], [16, 15]]
    assert values(S.TimeSeriesSlidingWindow(2, stride=2).apply(frame(spark, (a(42, 43, 44, 45),)))) == [[42, 43], [44, 45]]
    assert values(S.TimeSeriesSlidingWindow(3).apply(frame(spark, (a(1, 2),), (None,), ([],)))) == []
    two = frame(spark, (a(42, 43, 44), a(17, 16, 15), "x"), columns=("a", "b", "c"), kind=(TS, TS, "string"))
    out = S.TimeSeriesSlidingWindow(2, ["a", "b"]).apply(two)
    assert values(out, "b") == [[17, 16], [16, 15]] and [r["c"] for r in out.collect()] == ["x", "x"]
    with pytest.raises(Exception, match="differ in length"):
        S.TimeSeriesSlidingWindow(2).apply(frame(spark, (a(1, 2, 3), a(1, 2)), columns=("a", "b"))).collect()


def test_row_windows(spark):
    df = spark.createDataFrame([(k, 10 * k, 100 * k) for k in range(1, 6)], "x long, y long, z long").selectExpr("x as k", "*")
    out = S.SlidingWindow(3, "k", features=["x", "y", "z"]).apply(df)
    assert out.columns[1:] == [f"{c}_{i}" for i in range(3) for c in "xyz"]
    assert [tuple(r)[1:4] for r in out.orderBy("k").collect()] == [(1, 10, 100), (2, 20, 200), (3, 30, 300)]


def test_to_series(spark):
    df = spark.createDataFrame([(3, 45, 0), (0, 42, 3), (2, 44, 1), (1, 43, 2)], "t long, a long, b long")
    out = S.ToTimeSeries("t").apply(df)
    assert out.columns == ["a", "b"] and cells(out, "a") == [[(0, 42), (1, 43), (2, 44), (3, 45)]]
    assert S.ToTimeSeries({"a": "t"}).apply(df).columns == ["a"]
    with pytest.raises(FeatureNotFoundError):
        S.ToTimeSeries("nope").apply(df)


@pytest.mark.parametrize("kind", ["timestamp", "double", "long"])
def test_match_sampling_rate(spark, kind):
    value = "struct<x:double,y:double>"
    series = lambda *s: f"array({', '.join(f'named_struct({chr(39)}time{chr(39)}, cast({t} as {kind}), {chr(39)}value{chr(39)}, {v})' for t, v in s)})"
    xy = lambda x, y: f"named_struct('x', {x}D, 'y', {y}D)"
    df = spark.sql(f"select {series(*((t, xy(t, t)) for t in (1, 2, 3, 4)))} a, {series((0, xy(1.0, 10.0)), (5, xy(2.0, 20.0)))} b, 1 c")
    out = S.MatchSamplingRate("a", {"b": "linear"}).apply(df)
    got = out.first()["b"]
    assert [round(s["value"]["x"], 9) for s in got] == [1.2, 1.4, 1.6, 1.8] and [round(s["value"]["y"], 9) for s in got] == [12, 14, 16, 18]
    assert out.schema["b"].dataType.elementType["time"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert value in out.schema["b"].dataType.simpleString()


def test_match_sampling_rate_fills(spark):
    df = frame(spark, ([(t, 0.0) for t in (1.0, 2.0, 3.0, 4.0)], [(2.0, 1.0), (3.0, 2.0), (4.0, 3.0), (5.0, 4.0)]), columns=("a", "b"))
    value = lambda **kw: [v for _, v in cells(S.MatchSamplingRate("a", {"b": "linear"}, **kw).apply(df), "b")[0]]
    assert value(fill_strategy="zero") == [0, 1, 2, 3]
    assert value() == [1, 1, 2, 3] and value(fill_strategy="max") == [4, 1, 2, 3]
    uneven = frame(spark, ([(1.0, 0.0), (8.0, 0.0)], [(0.0, 0.0), (10.0, 10.0)]), columns=("a", "b"))
    assert [v for _, v in cells(S.MatchSamplingRate("a", by="time").apply(uneven), "b")[0]] == [1, 8]
    assert [round(v, 6) for _, v in cells(S.MatchSamplingRate("a").apply(uneven), "b")[0]] == [3.333333, 6.666667]
    assert [v for _, v in cells(S.MatchSamplingRate("a", {"b": "nearest"}, by="time").apply(uneven), "b")[0]] == [0, 10]


def test_zero_order_hold(spark):
    df = frame(spark, ([(0.0, 1.0), (2.0, 2.0)], [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]), (None, [(1.0, 1.0)]), ([], [(1.0, 1.0)]), columns=("a", "b"))
    out = S.ZeroOrderHold(["a", "b"]).apply(df)
    assert out.columns == ["aligned"]
    got = [None if r[0] is None else [(x["time"], x["value"]["a"], x["value"]["b"]) for x in r[0]] for r in out.collect()]
    assert got == [[(1, 1, 10), (2, 2, 20), (3, 2, 30)], None, []]


def test_slices(spark):
    df = spark.createDataFrame([([(float(t), float(t)) for t in (3, 4, 6, 9)], [4.0, 8.0, -1.0])], f"s {TS}, p array<double>")
    assert [[x["value"] for x in r["s"]] for r in S.SliceTimeSeries("s", "p").apply(df).collect()] == [[3, 4], [6], [9]]
    assert [[x["value"] for x in r["s"]] for r in S.SliceTimeSeries("s", "p", keep_tail=False).apply(df).collect()] == [[3, 4], [6]]


@pytest.mark.parametrize(("kind", "frequency", "wanted"), [("lowpass", 60, 5), ("highpass", 10, 80)])
def test_signal_filter(spark, kind, frequency, wanted):
    t = np.arange(200) / 200
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 80 * t)
    df = frame(spark, (list(zip(t.tolist(), x.tolist(), strict=True)), 1), columns=("a", "n"), kind=(TS, "long"))
    got = np.array([v for _, v in cells(S.SignalFilter("a", kind, frequency).apply(df), "a")[0]])
    assert ((got - np.sin(2 * np.pi * wanted * t)) ** 2).mean() <= 0.1


def test_delocalizations(spark):
    df = frame(spark, ([(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (3.0, 3.0)],))
    assert S.DetectDelocalizations("a", field=None).apply(df).first()["slice_points"] == [2.0, 3.0]


def test_series_columns(spark):
    df = frame(spark, ([(0.0, 1.0)], 1), columns=("a", "n"), kind=(TS, "long"))
    assert types.series_columns(df) == ["a"]
    with pytest.raises(NoTimeSeriesFeatureError):
        types.chosen_series(df, "n")
