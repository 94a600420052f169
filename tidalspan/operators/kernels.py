"""Arrow kernels over series cells, for what higher-order functions would do in quadratic time.

A kernel sees each row's series as numpy arrays cut from Arrow's buffers, without a shuffle and
without Python objects for samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidalspan import types

#: times and, by field ("" for a plain value), values of one cell
Cell = tuple[np.ndarray, dict[str, np.ndarray]]
Kernel = Callable[[dict[str, "Cell | None"]], dict[str, "Cell | None"]]

#: Samples that are read, or made, at a time.
SAMPLES = 100_000


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    return column.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)


def _cells(column: pa.ListArray) -> list[Cell | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    low = int(offsets[0]) if len(offsets) else 0
    elements, offsets = column.values.slice(low, int(offsets[-1]) - low if len(offsets) else 0), offsets - low
    times = _numbers(elements.field("time"))
    value = elements.field("value")
    fields = {f.name: _numbers(value.field(f.name)) for f in value.type} if pa.types.is_struct(value.type) else {"": _numbers(value)}
    nulls = column.is_null().to_pylist()
    return [None if null else (times[a:b], {k: v[a:b] for k, v in fields.items()}) for null, a, b in zip(nulls, offsets, offsets[1:], strict=False)]


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[kind.simpleString()]


def _column(cells: list[Cell | None], kind: T.ArrayType) -> pa.Array:
    element = kind.elementType
    time_kind, value_kind = element["time"].dataType, element["value"].dataType
    sizes = [0 if c is None else len(c[0]) for c in cells]
    times = np.concatenate([c[0] for c in cells if c is not None] or [np.zeros(0)])
    if isinstance(time_kind, T.TimestampType):
        time = pa.array(np.round(times).astype(np.int64)).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
    elif isinstance(time_kind, T.LongType | T.IntegerType):
        time = pa.array(np.round(times).astype(np.int64)).cast(_arrow(time_kind))
    else:
        time = pa.array(times, pa.float64()).cast(_arrow(time_kind))

    def joined(field: str) -> pa.Array:
        v = np.concatenate([c[1][field] for c in cells if c is not None] or [np.zeros(0)])
        return pa.array(v, pa.float64(), mask=np.isnan(v))

    if isinstance(value_kind, T.StructType):
        value = pa.StructArray.from_arrays([joined(f) for f in value_kind.names], names=value_kind.names)
    else:
        value = joined("")
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    elements = pa.StructArray.from_arrays([time, value], names=["time", "value"])
    made = pa.ListArray.from_arrays(pa.array(offsets), elements)
    if any(c is None for c in cells):
        made = pa.ListArray.from_arrays(pa.array(offsets), elements, mask=pa.array([c is None for c in cells]))
    return made


def pieces(batch: pa.RecordBatch, features: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that have about SAMPLES samples together, or one row that has more."""
    samples = sum(np.diff(batch.column(f).offsets.to_numpy()) for f in features)
    ends, first = np.cumsum(samples), 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + SAMPLES, side="right")))
        yield batch.slice(first, after - first)
        first = after


def map_series(df: DataFrame, features: list[str], kernel: Kernel, results: Mapping[str, T.ArrayType]) -> DataFrame:
    """df with the columns results, which kernel makes of each row's features. Values become doubles."""
    for f in features:
        types.chosen_series(df, [f])
    names, results = df.columns, dict(results)
    new = [c for c in results if c not in names]
    schema = T.StructType([T.StructField(f.name, results.get(f.name, f.dataType)) for f in df.schema.fields] + [T.StructField(c, results[c]) for c in new])

    def packed(batch: pa.RecordBatch, made: dict[str, list[Cell | None]]) -> pa.RecordBatch:
        columns = [_column(made[c], results[c]) if c in results else batch.column(k) for k, c in enumerate(names)]
        return pa.record_batch([*columns, *(_column(made[c], results[c]) for c in new)], names=[*names, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # both what is read and what is made come in pieces of about SAMPLES, whatever a batch holds
            for piece in pieces(batch, features):
                given = {f: _cells(piece.column(names.index(f))) for f in features}
                made: dict[str, list[Cell | None]] = {c: [] for c in results}
                first, size = 0, 0
                for k in range(piece.num_rows):
                    row = kernel({f: cells[k] for f, cells in given.items()})
                    for c in results:
                        made[c].append(row[c])
                        size += 0 if row[c] is None else len(row[c][0]) * len(row[c][1])
                    if size >= SAMPLES or k + 1 == piece.num_rows:
                        yield packed(piece.slice(first, k + 1 - first), made)
                        made, first, size = {c: [] for c in results}, k + 1, 0

    return df.mapInArrow(run, schema)


def double_series(df: DataFrame, column: str, time: T.DataType | None = None) -> T.ArrayType:
    """The column's type with double values, and its own or the given time."""
    kind = types.value_type(df, column)
    value = T.StructType([T.StructField(f, T.DoubleType()) for f in kind.names]) if isinstance(kind, T.StructType) else T.DoubleType()
    return types.series_type(time or types.time_type(df, column), value)


def tridiagonal(low: np.ndarray, middle: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves rows low[i] x[i-1] + middle[i] x[i] + high[i] x[i+1] = right[i], in one pass each way."""
    a, b, c, d = low.tolist(), middle.tolist(), high.tolist(), right.tolist()
    for i in range(1, len(b)):
        w = a[i] / b[i - 1]
        b[i] -= w * c[i - 1]
        d[i] -= w * d[i - 1]
    for i in range(len(b) - 1, -1, -1):
        d[i] = (d[i] - (c[i] * d[i + 1] if i + 1 < len(b) else 0.0)) / b[i]
    return np.array(d)


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends; a parabola for three points, a line for two."""
    n = len(x)
    if n < 2:
        return np.full(len(at), y[0] if n else np.nan)
    if n == 2:
        return y[0] + (at - x[0]) * (y[1] - y[0]) / (x[1] - x[0])
    if n == 3:
        return np.polyval(np.polyfit(x - x[0], y, 2), at - x[0])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    # second derivatives m: tridiagonal, after the ends' conditions (a continuous third derivative at
    # the second and the last but one point) have taken m[0] and m[-1] out of the inner rows
    low, middle, high, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    middle[0] += h[0] * (h[0] + h[1]) / h[1]
    high[0] -= h[0] * h[0] / h[1]
    middle[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] * h[-1] / h[-2]
    inner = tridiagonal(low, middle, high, right)
    m = np.concatenate([[0.0], inner, [0.0]])
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-2] + h[-1]) * m[-2] - h[-1] * m[-3]) / h[-2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right, w = at - x[k], x[k + 1] - at, h[k]
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * right + (y[k + 1] / w - m[k + 1] * w / 6) * left


def butterworth(order: int, frequency: float, rate: float, kind: str) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth filter."""
    if not 0 < frequency < rate / 2:
        raise ValueError("the cut-off frequency must lie between 0 and half the sampling rate")
    warped = 2 * rate * np.tan(np.pi * frequency / rate)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    poles = warped * poles if kind == "lowpass" else warped / poles
    z = (2 * rate + poles) / (2 * rate - poles)
    zero = -1.0 if kind == "lowpass" else 1.0
    sections = []
    upper = sorted((p for p in z if p.imag > 1e-12), key=abs)
    real = [p.real for p in z if abs(p.imag) <= 1e-12]
    for p in upper:
        sections.append([1.0, -2 * zero, 1.0, -2 * p.real, abs(p) ** 2])
    for p in real:
        sections.append([1.0, -zero, 0.0, -p, 0.0])
    out = np.array(sections)
    edge = 1.0 if kind == "lowpass" else -1.0  # where the gain is one
    gain = np.prod([(s[0] + s[1] / edge + s[2]) / (1 + s[3] / edge + s[4]) for s in out])
    out[0, :3] /= gain
    return out


#: Samples that a section of a filter takes at once, and blocks from which on that pays.
BLOCK, BLOCKS = 128, 64


@lru_cache(maxsize=64)
def _responses(section: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over a block: outputs by inputs, outputs by the two states, states by inputs, states by states."""
    b0, b1, b2, a1, a2 = section
    given = np.hstack([np.eye(BLOCK), np.zeros((BLOCK, 2))])
    s1, s2 = np.zeros(BLOCK + 2), np.zeros(BLOCK + 2)
    s1[BLOCK], s2[BLOCK + 1] = 1.0, 1.0
    out = np.empty((BLOCK, BLOCK + 2))
    for k, v in enumerate(given):
        out[k] = b0 * v + s1
        s1, s2 = b1 * v - a1 * out[k] + s2, b2 * v - a2 * out[k]
    after = np.stack([s1, s2])
    return out[:, :BLOCK], out[:, BLOCK:], after[:, :BLOCK], after[:, BLOCK:]


def filtered(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Runs the sections causally from rest (transposed direct form II), in long series a block of
    samples at a time: a block's outputs and last states are products with what it gets."""
    y, n = x.astype(np.float64), len(x)
    for section in map(tuple, sections.tolist()):
        b0, b1, b2, a1, a2 = section
        whole, s1, s2 = n // BLOCK, 0.0, 0.0
        if whole >= BLOCKS:
            by_input, by_state, to_state, state_to_state = _responses(section)
            blocks = y[: whole * BLOCK].reshape(whole, BLOCK)
            (p, q), (r, s) = state_to_state.tolist()
            states = []
            for u, v in (blocks @ to_state.T).tolist():
                states.append((s1, s2))
                s1, s2 = p * s1 + q * s2 + u, r * s1 + s * s2 + v
            head = (blocks @ by_input.T + np.array(states) @ by_state.T).ravel()
        else:
            head, whole = np.zeros(0), 0
        tail = y[whole * BLOCK :].tolist()
        for k, v in enumerate(tail):
            tail[k] = o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
        y = np.concatenate([head, tail])
    return y


def sliced(series: pa.ListArray, points: pa.ListArray, keep_tail: bool) -> tuple[np.ndarray, pa.ListArray]:
    """The rows of series that slices come from, and the slices: samples after a point (the sorted
    distinct ones above 0), up to and with the next; empty ones are left out."""
    rows, sizes, taken = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    times, numbers = _numbers(series.values.field("time")), _numbers(points.values)
    spans, cuts = series.offsets.to_numpy(), points.offsets.to_numpy()
    known = np.array([a and b for a, b in zip(series.is_valid().to_pylist(), points.is_valid().to_pylist(), strict=True)], bool)
    for k in np.flatnonzero(known).tolist():
        own = numbers[cuts[k] : cuts[k + 1]]
        at = np.unique(own[own > 0])
        number = np.searchsorted(at, times[spans[k] : spans[k + 1]], side="left")
        order = np.argsort(number, kind="stable")
        counts = np.bincount(number, minlength=len(at) + 1)[: len(at) + keep_tail]
        taken.append(order[: counts.sum()] + spans[k])
        sizes.append(counts[counts > 0])
        rows.append(np.full(len(sizes[-1]), k))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return np.concatenate(rows), pa.ListArray.from_arrays(pa.array(offsets), series.values.take(pa.array(np.concatenate(taken))))
