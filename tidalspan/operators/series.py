"""Transforms that make, reshape and summarise time series."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidalspan import types
from tidalspan.errors import FeatureLengthVaryError
from tidalspan.functions import series as S
from tidalspan.operators import kernels
from tidalspan.operators.base import Transform


class ToTimeSeries(Transform):
    """Rows to series: one row a group of keys, or one in all. time: the time column of all value
    columns, or {value: time column}, which keeps only those named."""

    def __init__(self, time: str | Mapping[str, str], keys: str | Sequence[str] = ()) -> None:
        self.time = time if isinstance(time, str) else dict(time)
        self.keys = [keys] if isinstance(keys, str) else list(keys)

    def apply(self, df: DataFrame) -> DataFrame:
        pairs = self.time if isinstance(self.time, dict) else {c: self.time for c in df.columns if c != self.time and c not in self.keys}
        types.require(df, [*pairs, *pairs.values(), *self.keys])
        made = [F.array_sort(F.collect_list(F.struct(F.col(t).alias("time"), F.col(v).alias("value")))).alias(v) for v, t in pairs.items()]
        return df.groupBy(*self.keys).agg(*made)


class Flatten(Transform):
    """Series of one length n to columns f_0 ... f_(n-1); fit (or the first apply) finds n. With padded,
    lengths may vary: n is the longest, and what a series does not have is null."""

    def __init__(self, features: str | Iterable[str] | None = None, padded: bool = False) -> None:
        self.features, self.padded = features, padded
        self.lengths: dict[str, int] | None = None

    def fit(self, df: DataFrame) -> Flatten:
        names = types.chosen_series(df, self.features)
        row = df.agg(*(f(F.size(F.col(c))).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max)))).first()
        for i, c in enumerate(names):
            if row[f"a{i}"] != row[f"b{i}"] and not self.padded:
                raise FeatureLengthVaryError(f"{c} has {row[f'a{i}']} to {row[f'b{i}']} samples")
        self.lengths = {c: max(row[f"b{i}"] or 0, 0) for i, c in enumerate(names)}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        if self.lengths is None:
            self.fit(df)
        out = []
        for c in df.columns:
            if c in self.lengths:
                out += [F.get(F.col(f"`{c}`"), F.lit(k))["value"].alias(f"{c}_{k}") for k in range(self.lengths[c])]
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)


class SlidingWindow(Transform):
    """Lag features: a row and the size - 1 before it in one; columns x_0 (oldest), y_0, ..., x_1, ..."""

    def __init__(self, window_size: int, order_by: str | Sequence[str], keys: str | Sequence[str] = (), features: Sequence[str] | None = None) -> None:
        self.size = window_size
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.features = features

    def apply(self, df: DataFrame) -> DataFrame:
        fixed = [*self.keys, *self.order_by]
        names = list(self.features) if self.features is not None else [c for c in df.columns if c not in fixed]
        types.require(df, [*fixed, *names])
        w = W.partitionBy(*self.keys).orderBy(*self.order_by)
        lags = [F.lag(c, self.size - 1 - k).over(w).alias(f"{c}_{k}") for k in range(self.size) for c in names]
        kept = [c for c in df.columns if c in fixed]
        rows = df.select(*kept, *lags, F.row_number().over(w).alias("_n"))
        return rows.where(F.col("_n") >= self.size).drop("_n")


class TimeSeriesSlidingWindow(Transform):
    """A row for each window of its series, which must be of one length within the row."""

    def __init__(self, window_size: int, features: str | Iterable[str] | None = None, stride: int = 1) -> None:
        self.size, self.features, self.stride = window_size, features, stride

    def apply(self, df: DataFrame) -> DataFrame:
        names = types.chosen_series(df, self.features)
        same = F.lit(True)
        for c in names[1:]:
            same = same & F.size(names[0]).eqNullSafe(F.size(c))
        checked = F.when(same, F.col(names[0])).otherwise(F.raise_error(F.lit("the series of a row differ in length")).cast(df.schema[names[0]].dataType))
        zipped = F.arrays_zip(*(S.windows(checked if k == 0 else F.col(c), self.size, self.stride).alias(f"w{k}") for k, c in enumerate(names)))
        rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
        rows = df.select(*rest, F.explode(zipped).alias("_w"))
        return rows.select(*(F.col(f"_w.w{names.index(c)}").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


class TimeWindow(Transform):
    def __init__(self, features: str | Iterable[str] | None = None, time_start: float = 0.0, time_end: float = math.inf) -> None:
        self.features, self.start, self.end = features, time_start, time_end

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: S.between(c, self.start, self.end) for c in types.chosen_series(df, self.features)})


class Pad(Transform):
    def __init__(self, length: float, features: str | Iterable[str] | None = None) -> None:
        self.length, self.features = length, features

    def apply(self, df: DataFrame) -> DataFrame:
        names = types.chosen_series(df, self.features)
        return df.withColumns({c: S.pad(c, self.length, types.time_type(df, c).simpleString()) for c in names})


class DiscreteDerivative(Transform):
    def __init__(self, features: str | Iterable[str], method: str = "central", derivative_suffix: str = "_derivative") -> None:
        if method not in ("central", "forward", "backward"):
            raise ValueError(f"unknown method {method!r}")
        self.features, self.method, self.suffix = features, method, derivative_suffix

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}{self.suffix}": S.derivative(c, self.method) for c in types.chosen_series(df, self.features)})


class _Summary(Transform):
    """One number a cell, beside the series or in its place."""

    name = ""

    def __init__(self, features: str | Iterable[str], replace: bool = False) -> None:
        self.features, self.replace = features, replace

    def column(self, c: str) -> Column:
        return getattr(S, self.name)(c)

    def apply(self, df: DataFrame) -> DataFrame:
        names = types.chosen_series(df, self.features)
        return df.withColumns({c if self.replace else f"{c}_{self.name}": self.column(c) for c in names})


class Mean(_Summary):
    name = "mean"


class Median(_Summary):
    name = "median"


class Mode(_Summary):
    name = "mode"


class First(_Summary):
    name = "first"


class Last(_Summary):
    name = "last"


class Resample(Transform):
    """Series on a regular grid. The grid has int(ceil(span) / period) + 1 points from the first to
    the last time, so its step is the period only where that divides the span."""

    def __init__(self, period: float | Mapping[str, float], interpolation_method: str = "linear") -> None:
        if interpolation_method not in ("linear", "cubic"):
            raise ValueError(f"unknown interpolation {interpolation_method!r}")
        self.period = dict(period) if isinstance(period, Mapping) else float(period)
        self.method = interpolation_method

    def apply(self, df: DataFrame) -> DataFrame:
        periods = self.period if isinstance(self.period, dict) else dict.fromkeys(types.chosen_series(df, None), self.period)
        method = self.method

        def kernel(row: dict) -> dict:
            out = {}
            for c, period in periods.items():
                if row[c] is None or not len(row[c][0]):
                    out[c] = row[c]
                    continue
                t, fields = row[c]
                grid = np.linspace(t[0], t[-1], int(np.ceil(t[-1] - t[0]) / period) + 1)
                out[c] = grid, {f: np.interp(grid, t, v) if method == "linear" else kernels.cubic(t, v, grid) for f, v in fields.items()}
            return out

        return kernels.map_series(df, list(periods), kernel, {c: kernels.double_series(df, c, T.DoubleType()) for c in periods})


class SignalFilter(Transform):
    """Causal Butterworth filter; the sampling rate is that of the first two samples."""

    def __init__(self, features: str | Iterable[str], filter_type: str, frequency: float, order: int = 5) -> None:
        if filter_type not in ("lowpass", "highpass"):
            raise ValueError(f"unknown filter {filter_type!r}")
        self.features, self.kind, self.frequency, self.order = features, filter_type, frequency, order

    def apply(self, df: DataFrame) -> DataFrame:
        names = types.chosen_series(df, self.features)
        kind, frequency, order = self.kind, self.frequency, self.order

        def kernel(row: dict) -> dict:
            out = {}
            for c in names:
                if row[c] is None or len(row[c][0]) < 2:
                    out[c] = row[c]
                    continue
                t, fields = row[c]
                sections = kernels.butterworth(order, frequency, 1 / (t[1] - t[0]), kind)
                out[c] = t, {f: kernels.filtered(sections, v) for f, v in fields.items()}
            return out

        return kernels.map_series(df, names, kernel, {c: kernels.double_series(df, c) for c in names})


FILLS = ("both_ways", "forward", "backward", "min", "max", "mean", "zero", "one")


def _filled(v: np.ndarray, how: str) -> np.ndarray:
    known = np.flatnonzero(~np.isnan(v))
    if how in ("zero", "one"):
        return np.where(np.isnan(v), float(how == "one"), v)
    if not len(known):
        return v
    if how in ("min", "max", "mean"):
        return np.where(np.isnan(v), getattr(np, f"nan{how}")(v), v)
    at = np.arange(len(v))
    if how in ("both_ways", "backward"):
        after = np.searchsorted(known, at)
        v = np.where(np.isnan(v) & (after < len(known)), v[known[np.minimum(after, len(known) - 1)]], v)
        known = np.flatnonzero(~np.isnan(v))
    if how in ("both_ways", "forward"):
        before = np.searchsorted(known, at, side="right") - 1
        v = np.where(np.isnan(v) & (before >= 0), v[known[np.maximum(before, 0)]], v)
    return v


class MatchSamplingRate(Transform):
    """Series at the times of a reference series.

    The union of both times is the grid. Between known samples values are interpolated, by="position"
    on the grid (rows count as equally far apart) or by="time"; edges are filled by a strategy over
    the grid; then the reference times are kept. Of samples with equal times the last holds.
    """

    def __init__(self, reference: str, interpolations: Mapping[str, str] | None = None, fill_strategy: str = "both_ways", by: str = "position") -> None:
        if fill_strategy not in FILLS or by not in ("position", "time"):
            raise ValueError("unknown fill strategy or distance")
        if interpolations and set(interpolations.values()) - {"linear", "nearest"}:
            raise ValueError("interpolations are linear or nearest")
        self.reference, self.interpolations, self.fill, self.by = reference, interpolations, fill_strategy, by

    def apply(self, df: DataFrame) -> DataFrame:
        methods = dict(self.interpolations) if self.interpolations is not None else {c: "linear" for c in types.series_columns(df) if c != self.reference}
        reference, fill, by = self.reference, self.fill, self.by

        def kernel(row: dict) -> dict:
            out: dict = {}
            for c, method in methods.items():
                if row[c] is None or row[reference] is None:
                    out[c] = None
                    continue
                wanted = row[reference][0]
                t, fields = row[c]
                grid = np.unique(np.concatenate((wanted, t)))
                at, made = np.searchsorted(grid, t), {}
                axis = np.arange(len(grid), dtype=float) if by == "position" else grid
                for f, given in fields.items():
                    v = np.full(len(grid), np.nan)
                    v[at] = given
                    known = np.flatnonzero(~np.isnan(v))
                    if len(known):
                        inside = np.arange(known[0], known[-1] + 1)
                        if method == "linear":
                            v[inside] = np.interp(axis[inside], axis[known], v[known])
                        else:
                            after = np.searchsorted(known, inside)
                            before = np.maximum(np.searchsorted(known, inside, side="right") - 1, 0)
                            to_before, to_after = axis[inside] - axis[known[before]], axis[known[after]] - axis[inside]
                            v[inside] = np.where(to_before < to_after, v[known[before]], v[known[after]])
                    made[f] = _filled(v, fill)[np.searchsorted(grid, wanted)]
                out[c] = wanted, made
            return out

        results = {c: kernels.double_series(df, c, types.time_type(df, self.reference)) for c in methods}
        return kernels.map_series(df, [self.reference, *methods], kernel, results)


class ZeroOrderHold(Transform):
    """Several series on the union of their times, each holding its last value; times before every
    series has begun are left out. The values become one struct with a field for each series, or
    for each field of it, named series/field."""

    def __init__(self, features: Iterable[str], name: str = "aligned", drop: bool = True) -> None:
        self.features, self.name, self.drop = list(features), name, drop

    def apply(self, df: DataFrame) -> DataFrame:
        names = types.chosen_series(df, self.features)
        inner = {c: getattr(types.value_type(df, c), "names", [""]) for c in names}
        fields = [(c, f, f"{c}/{f}" if f else c) for c in names for f in inner[c]]
        result = self.name
        kind = types.series_type(types.time_type(df, names[0]), T.StructType([T.StructField(n, T.DoubleType()) for _, _, n in fields]))

        def kernel(row: dict) -> dict:
            if any(row[c] is None for c in names):
                return {result: None}
            grid = np.unique(np.concatenate([row[c][0] for c in names]))
            made, whole = {}, np.ones(len(grid), bool)
            for c, f, n in fields:
                t, v = row[c][0], row[c][1][f]
                order = np.argsort(t, kind="stable")
                t, v = t[order], v[order]
                known = ~np.isnan(v)
                t, v = t[known], v[known]
                at = np.searchsorted(t, grid, side="right") - 1
                made[n] = np.where(at >= 0, v[np.maximum(at, 0)], np.nan) if len(v) else np.full(len(grid), np.nan)
                whole &= ~np.isnan(made[n])
            return {result: (grid[whole], {n: v[whole] for n, v in made.items()})}

        out = kernels.map_series(df, names, kernel, {result: kind})
        return out.drop(*(c for c in names if c != result)) if self.drop else out


class SliceTimeSeries(Transform):
    """A row for each slice of a series: samples up to and with each slice point, after the one
    before. Samples after the last point are a further slice unless keep_tail is off. Points at or
    below 0 are ignored; slices without samples give no row."""

    def __init__(self, time_series: str, slice_points: str, keep_tail: bool = True) -> None:
        self.series, self.points, self.keep_tail = time_series, slice_points, keep_tail

    def apply(self, df: DataFrame) -> DataFrame:
        types.chosen_series(df, [self.series])
        types.require(df, [self.points])
        names, keep_tail = df.columns, self.keep_tail
        at, cut = names.index(self.series), names.index(self.points)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, slices = kernels.sliced(batch.column(at), batch.column(cut), keep_tail)
                yield pa.record_batch([slices if k == at else c.take(pa.array(rows)) for k, c in enumerate(batch.columns)], names=names)

        return df.mapInArrow(run, df.schema)


class DetectDelocalizations(Transform):
    """Times at which a counter series rises, as an array column."""

    def __init__(self, counter_column: str, name: str = "slice_points", field: str | None = "data") -> None:
        self.counter, self.name, self.field = counter_column, name, field

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, S.delocalizations(self.counter, self.field))


class LocalizationStatus(Transform):
    """Adds position and heading error and their verdict to each sample of a series of two poses.

    The value has the fields truth and estimate, each with position (x, y) and orientation (x, y, z, w).
    """

    def __init__(self, series: str, position_threshold: float, heading_threshold: float, truth: str = "truth", estimate: str = "estimate") -> None:
        self.series, self.position, self.heading, self.truth, self.estimate = series, position_threshold, heading_threshold, truth, estimate

    def apply(self, df: DataFrame) -> DataFrame:
        def judged(x: Column) -> Column:
            a, b = x["value"][self.truth], x["value"][self.estimate]
            distance = F.sqrt(F.pow(a["position"]["x"] - b["position"]["x"], 2) + F.pow(a["position"]["y"] - b["position"]["y"], 2))
            turn = S.yaw(a["orientation"]) - S.yaw(b["orientation"])
            heading = F.abs(F.atan2(F.sin(turn), F.cos(turn)))
            wrong = (distance > self.position) | (heading > self.heading)
            value = x["value"].withField("position_error", distance).withField("heading_error", heading).withField("is_delocalized", wrong)
            return F.struct(x["time"].alias("time"), value.alias("value"))

        return df.withColumn(self.series, F.transform(self.series, judged))


class FlatDerivative(Transform):
    """Differences between the columns prefix_0, prefix_1, ...; the first is 0."""

    def __init__(self, column_prefix: str) -> None:
        self.prefix = column_prefix

    def apply(self, df: DataFrame) -> DataFrame:
        numbers = sorted(int(c[len(self.prefix) + 1 :]) for c in df.columns if c.startswith(f"{self.prefix}_") and c[len(self.prefix) + 1 :].isdigit())
        made = {f"{self.prefix}_derivative_{k}": F.lit(0.0) if k == numbers[0] else F.col(f"{self.prefix}_{k}") - F.col(f"{self.prefix}_{b}") for b, k in zip([None, *numbers], numbers, strict=False)}
        return df.withColumns(made)
