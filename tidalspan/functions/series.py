"""Column expressions over time series cells: higher-order functions, no shuffle, no Python.

All give null for a null cell and are safe under ANSI mode on empty arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def values(series: Column | str) -> Column:
    """The values that are not null, in order."""
    return F.filter(_col(series)["value"], lambda v: v.isNotNull())


def mean(series: Column | str) -> Column:
    v = values(series)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.try_divide(total, F.size(v))


def median(series: Column | str) -> Column:
    s = F.array_sort(values(series))
    n = F.size(s)
    lower, upper = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower.cast("double") + upper.cast("double")) / 2)


def mode(series: Column | str) -> Column:
    """The most frequent value; of several the greatest."""
    ordered = F.array_sort(values(series))
    least = F.get(ordered, F.lit(0))
    start = F.struct(F.lit(0).alias("most"), least.alias("best"), F.lit(0).alias("run"), least.alias("value"))

    def step(done: Column, x: Column) -> Column:  # equal values stand side by side
        run = F.when(x == done["value"], done["run"] + 1).otherwise(1)
        wins = run >= done["most"]
        return F.struct(F.greatest(run, done["most"]).alias("most"), F.when(wins, x).otherwise(done["best"]).alias("best"), run.alias("run"), x.alias("value"))

    return F.aggregate(ordered, start, step, lambda done: done["best"])


def first(series: Column | str) -> Column:
    return F.get(_col(series), F.lit(0))["value"]


def last(series: Column | str) -> Column:
    return F.try_element_at(_col(series), F.lit(-1))["value"]


def between(series: Column | str, start: float = 0.0, end: float = math.inf) -> Column:
    """Samples with start <= time <= end."""
    return F.filter(_col(series), lambda x: (x["time"] >= F.lit(start)) & (x["time"] <= F.lit(end)))


def pad(series: Column | str, length: float, time: str = "double") -> Column:
    """Repeats the last value at length if the series ends before."""
    c = _col(series)
    end = F.try_element_at(c, F.lit(-1))
    return F.when(end["time"] < F.lit(length), F.concat(c, F.array(F.struct(F.lit(length).cast(time).alias("time"), end["value"].alias("value"))))).otherwise(c)


def windows(series: Column | str, size: int, stride: int = 1) -> Column:
    """array<series>: every stride-th run of size samples; none if the series is shorter."""
    c = _col(series)
    n = F.size(c)
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride))
    return F.when(c.isNull(), None).when(n >= size, F.transform(starts, lambda i: F.slice(c, i + 1, F.lit(size)))).otherwise(F.slice(F.array(c), 1, 0))


def derivative(series: Column | str, method: str = "central") -> Column:
    """Difference quotients: forward keeps left stamps, backward right ones, central inner ones."""
    c = _col(series)
    gap = 2 if method == "central" else 1
    n = F.greatest(F.size(c) - gap, F.lit(0))
    left, right = F.slice(c, F.lit(1), n), F.slice(c, F.lit(1 + gap), n)
    at = {"forward": left, "backward": right, "central": F.slice(c, F.lit(2), n)}[method]

    def quotient(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.struct(pair["at"]["time"].alias("time"), F.try_divide((b["value"] - a["value"]).cast("double"), (b["time"] - a["time"]).cast("double")).alias("value"))

    return F.transform(F.arrays_zip(left.alias("a"), right.alias("b"), at.alias("at")), quotient)


def resample_linear(series: Column | str, period: float) -> Column:
    """Values on a grid from the first to the last time with int(ceil(span) / period) + 1 points.

    Searches all samples for each grid point: for short series; longer ones have a vectorised kernel.
    """
    c = F.transform(_col(series), lambda x: F.struct(x["time"].cast("double").alias("time"), x["value"].cast("double").alias("value")))
    t0, t1 = F.get(c, F.lit(0))["time"], F.try_element_at(c, F.lit(-1))["time"]
    steps = F.floor(F.ceil(t1 - t0).cast("double") / F.lit(float(period))).cast("int")

    def at(i: Column) -> Column:
        t = F.when(i == steps, t1).otherwise(t0 + i * F.coalesce(F.try_divide(t1 - t0, steps.cast("double")), F.lit(0.0)))
        before = F.try_element_at(F.filter(c, lambda x: x["time"] <= t), F.lit(-1))
        after = F.get(F.filter(c, lambda x: x["time"] >= t), F.lit(0))
        slope = F.coalesce(F.try_divide(after["value"] - before["value"], after["time"] - before["time"]), F.lit(0.0))
        return F.struct(t.alias("time"), (before["value"] + (t - before["time"]) * slope).alias("value"))

    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), at)).otherwise(c)


def delocalizations(series: Column | str, field: str | None = "data") -> Column:
    """Times at which a counter rises."""
    c = _col(series)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    value = lambda x: x["value"][field] if field else x["value"]
    pairs = F.arrays_zip(F.slice(c, F.lit(1), n).alias("a"), F.slice(c, F.lit(2), n).alias("b"))
    return F.transform(F.filter(pairs, lambda p: value(p["b"]) > value(p["a"])), lambda p: p["b"]["time"])


def yaw(q: Column) -> Column:
    """Heading of a quaternion with fields x, y, z, w."""
    return F.atan2(2 * (q["w"] * q["z"] + q["x"] * q["y"]), 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]))
