"""Ordinary differential equations: an adaptive Runge-Kutta pair of orders 5 and 4."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Flow = Callable[[float, np.ndarray], np.ndarray]

# The coefficients of the Dormand-Prince pair.
_C = np.array([0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1])
_A = [
    [],
    [1 / 5],
    [3 / 40, 9 / 40],
    [44 / 45, -56 / 15, 32 / 9],
    [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729],
    [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656],
    [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84],
]
_B = np.array([35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0])
_E = np.array([71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40])

#: Samples of traces that are made together.
SAMPLES = 50_000


class Step:
    """One accepted step: a cubic between its ends that meets both slopes."""

    def __init__(self, t0: float, x0: np.ndarray, f0: np.ndarray, t1: float, x1: np.ndarray, f1: np.ndarray) -> None:
        self.t0, self.x0, self.f0, self.t1, self.x1, self.f1 = t0, x0, f0, t1, x1, f1

    def at(self, t: float) -> np.ndarray:
        h = self.t1 - self.t0
        s = (t - self.t0) / h
        return (1 + 2 * s) * (1 - s) ** 2 * self.x0 + s * (1 - s) ** 2 * h * self.f0 + s * s * (3 - 2 * s) * self.x1 + s * s * (s - 1) * h * self.f1


def steps(flow: Flow, t0: float, x0: np.ndarray, t1: float, rtol: float = 1e-7, atol: float = 1e-9, max_step: float = np.inf) -> Iterator[Step]:
    """Accepted steps from t0 to t1."""
    t, x = float(t0), np.asarray(x0, float)
    f = np.asarray(flow(t, x), float)
    scale = atol + rtol * np.abs(x)
    h = min(max_step, t1 - t0, 0.01 * max(1e-6, float(np.linalg.norm(x / scale)) / max(1e-12, float(np.linalg.norm(f / scale))))) or 1e-6
    while t < t1:
        h = min(h, t1 - t, max_step)
        k = np.empty((7, len(x)))
        k[0] = f
        for i in range(1, 7):
            k[i] = flow(t + _C[i] * h, x + h * (np.array(_A[i]) @ k[:i]))
        new = x + h * (_B @ k)
        error = h * (_E @ k) / (atol + rtol * np.maximum(np.abs(x), np.abs(new)))
        size = float(np.sqrt(np.mean(error * error))) if len(x) else 0.0
        if size <= 1:
            end = t1 if t1 - (t + h) < 1e-14 * max(1.0, abs(t1)) else t + h
            yield Step(t, x, f, end, new, k[6].copy())
            t, x, f = end, new, k[6].copy()
        h *= min(5.0, max(0.2, 0.9 * size**-0.2 if size > 0 else 5.0))
        if h < 1e-15 * max(1.0, abs(t)):
            raise ArithmeticError("the step has become too small")


def solve(flow: Flow, t0: float, x0: np.ndarray, t1: float, **kw) -> tuple[np.ndarray, np.ndarray]:
    """Times and states at all accepted steps, the start included."""
    t, x = [t0], [np.asarray(x0, float)]
    for s in steps(flow, t0, x0, t1, **kw):
        t.append(s.t1)
        x.append(s.x1)
    return np.array(t), np.array(x)


def vectorised(flow: Flow) -> Flow:
    """Says of a flow that it takes many states at once: t as one number a state and x as a matrix with
    a column a state, for which it gives a matrix like x."""
    flow.vectorised = True
    return flow


def sampled(flow: Flow, at: np.ndarray, x0: np.ndarray, t1: float, rtol: float = 1e-7, atol: float = 1e-9, max_step: float = np.inf) -> np.ndarray:
    """Points at the times `at` (from the start on) for each column of x0, by a vectorised flow: what
    steps gives for each alone, as every column has steps of its own. Times x states x columns."""
    at = at[: 1 + int((at[1:] <= t1).sum())]
    out = np.empty((len(at), *x0.shape))
    out[0] = x0
    rows, x, t = np.arange(x0.shape[1]), np.array(x0, float), np.full(x0.shape[1], float(at[0]))
    if not t1 > at[0]:
        return out[:1]
    norm = lambda v: np.sqrt((v * v).sum(axis=0))
    f = np.array(flow(t, x), float)
    scale = atol + rtol * np.abs(x)
    h = np.minimum(min(max_step, t1 - at[0]), 0.01 * np.maximum(1e-6, norm(x / scale) / np.maximum(1e-12, norm(f / scale))))
    h, k = np.where(h == 0, 1e-6, h), np.ones(len(rows), int)
    while len(rows):
        h = np.minimum(np.minimum(h, t1 - t), max_step)
        slope = np.empty((7, *x.shape))
        slope[0] = f
        for i in range(1, 7):
            slope[i] = flow(t + _C[i] * h, x + h * np.tensordot(_A[i], slope[:i], 1))
        new = x + h * np.tensordot(_B, slope, 1)
        error = h * np.tensordot(_E, slope, 1) / (atol + rtol * np.maximum(np.abs(x), np.abs(new)))
        size = np.sqrt((error * error).mean(axis=0)) if len(x) else np.zeros(len(rows))
        size = np.where(np.isnan(size), np.inf, size)
        good = size <= 1
        end = np.where(t1 - (t + h) < 1e-14 * np.maximum(1.0, np.abs(t1)), t1, t + h)
        due = good & (k < len(at))
        while (due := due & (at[np.minimum(k, len(at) - 1)] <= end)).any():
            c = np.flatnonzero(due)
            step = Step(t[c], x[:, c], f[:, c], end[c], new[:, c], slope[6][:, c])
            out[k[c], :, rows[c]] = step.at(at[k[c]]).T
            k[c] += 1
            due = good & (k < len(at))
        t, x, f = np.where(good, end, t), np.where(good, new, x), np.where(good, slope[6], f)
        h = h * np.minimum(5.0, np.maximum(0.2, 0.9 * np.maximum(size, 1e-300) ** -0.2))
        left = t < t1
        if (h[left] < 1e-15 * np.maximum(1.0, np.abs(t[left]))).any():
            raise ArithmeticError("the step has become too small")
        if not left.all():
            rows, x, f, t, h, k = rows[left], x[:, left], f[:, left], t[left], h[left], k[left]
    return out


class OdeSystem:
    """A state that flows; step(dt) gives the points after the present one."""

    def __init__(self, flow: Flow, t: float, state: np.ndarray) -> None:
        self.flow, self.t, self.state = flow, t, np.asarray(state, float)

    def step(self, dt: float) -> tuple[np.ndarray, np.ndarray]:
        t, x = solve(self.flow, self.t, self.state, self.t + dt)
        self.t, self.state = float(t[-1]), x[-1]
        return t[1:], x[1:]


def trace_schema(states: int, extra: tuple[str, ...] = ()) -> T.StructType:
    fields = [T.StructField("trace_id", T.LongType()), T.StructField("step", T.IntegerType()), T.StructField("t", T.DoubleType())]
    fields += [T.StructField(e, T.StringType()) for e in extra]
    return T.StructType(fields + [T.StructField(f"x{k}", T.DoubleType()) for k in range(states)])


def grid(t0: float, t1: float, dt: float) -> np.ndarray:
    n = int(np.floor((t1 - t0) / dt * (1 + 1e-12)))
    at = t0 + dt * np.arange(n + 1)
    return at if abs(at[-1] - t1) < 1e-9 * max(1, abs(t1)) else np.append(at, t1)


def pieces(frame: pd.DataFrame, samples: int) -> Iterator[pd.DataFrame]:
    """Rows of starts, as many as have about SAMPLES samples together."""
    size = max(1, SAMPLES // samples)
    for k in range(0, len(frame), size):
        yield frame.iloc[k : k + size]


def spread(starts: DataFrame) -> DataFrame:
    """trace_id and x0, dealt out: starts are small and their traces are not, so that a file of them must
    not be one task."""
    parts = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), starts.sparkSession.sparkContext.defaultParallelism)
    return starts.select("trace_id", "x0").repartition(parts, "trace_id")


def simulate_frame(starts: DataFrame, flow: Flow, span: tuple[float, float], dt: float, states: int, rtol: float = 1e-7, atol: float = 1e-9) -> DataFrame:
    """A trace for each row (trace_id, x0), sampled every dt; rows are independent, so it is one map.
    A vectorised flow takes many rows at once."""
    many = getattr(flow, "vectorised", False)

    def alone(x0: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, k = [x0], 1
        for s in steps(flow, span[0], x0, span[1], rtol, atol):
            while k < len(at) and at[k] <= s.t1:
                out.append(s.at(at[k]))
                k += 1
        return np.array(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = grid(*span, dt)
        for frame in frames:
            for piece in pieces(frame, len(at)):
                x0 = [np.asarray(x, float) for x in piece["x0"]]
                traces = sampled(flow, at, np.array(x0).T, span[1], rtol, atol).transpose(2, 0, 1) if many else np.array([alone(x, at) for x in x0])
                n, m = traces.shape[:2]
                yield pd.DataFrame({"trace_id": np.repeat(piece["trace_id"].to_numpy(), m), "step": np.tile(np.arange(m, dtype=np.int32), n), "t": np.tile(at[:m], n), **{f"x{j}": traces[:, :, j].ravel() for j in range(states)}})

    return spread(starts).mapInPandas(run, trace_schema(states))
