"""Hybrid systems: locations with flows, guarded transitions with resets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidalspan.sim.ode import Flow, Step, grid, steps, trace_schema

#: The values of a system's inputs at a time.
Inputs = Callable[[float], np.ndarray]
#: Integration goes on this long after an event.
AFTER = 1e-12


@dataclass
class Transition:
    """Taken when guard crosses 0: upwards (1), downwards (-1) or either way (0). In a system with
    inputs, guard and reset get them as a third argument, like flows."""

    source: str
    target: str
    guard: Callable[[float, np.ndarray], float]
    direction: int = 0
    reset: Callable[[float, np.ndarray], np.ndarray] = field(default=lambda t, x: x)


@dataclass
class HybridSystem:
    flows: dict[str, Flow]
    transitions: list[Transition]
    initial: str

    def leaving(self, location: str) -> list[Transition]:
        return [t for t in self.transitions if t.source == location]


@dataclass
class Event:
    time: float
    source: str
    target: str
    state: np.ndarray


@dataclass
class Trace:
    t: np.ndarray
    x: np.ndarray
    location: list[str]
    events: list[Event]
    u: np.ndarray | None = None
    dx: np.ndarray | None = None


def _crossed(a: float, b: float, direction: int) -> bool:
    return (direction >= 0 and a < 0 <= b) or (direction <= 0 and a > 0 >= b)


def _root(step: Step, t: Transition) -> float:
    """Time of the crossing within a step, by bisection."""
    low, high = step.t0, step.t1
    before = t.guard(low, step.x0)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        value = t.guard(middle, step.at(middle))
        if _crossed(before, value, t.direction):
            high = middle
        else:
            low, before = middle, value
    return high


def with_inputs(system: HybridSystem, inputs: Inputs) -> HybridSystem:
    """A system of time and state alone: flows, guards and resets get what the inputs are at the time."""
    bound = lambda f: lambda t, x: f(t, x, np.asarray(inputs(t), float))
    return HybridSystem(
        {k: bound(f) for k, f in system.flows.items()},
        [Transition(tr.source, tr.target, bound(tr.guard), tr.direction, bound(tr.reset)) for tr in system.transitions], system.initial,
    )


def simulate(
    system: HybridSystem, span: tuple[float, float], x0: np.ndarray, location: str | None = None, max_jumps: int = 256, sample_dt: float | None = None, rtol: float = 1e-7, atol: float = 1e-9,
    inputs: Inputs | None = None, capture_inputs: bool | None = None, capture_derivatives: bool = False, max_step: float = np.inf, sample_times: Sequence[float] | None = None,
) -> Trace:
    """Integrates; at the earliest crossing resets and changes the location. Without sample_dt and
    sample_times the trace has the solver's own steps. A reset that leaves another guard at or past
    its threshold chains transitions at once; max_jumps bounds them all. inputs: time -> values, for
    systems whose functions take them; they are captured unless capture_inputs says otherwise."""
    if inputs is None and capture_inputs:
        raise ValueError("there are no inputs to capture")
    if inputs is not None:
        system = with_inputs(system, inputs)
    trace = _simulate(system, span, x0, location, max_jumps, sample_dt, rtol, atol, max_step, sample_times)
    if inputs is not None and capture_inputs is not False:
        trace.u = np.array([np.asarray(inputs(t), float) for t in trace.t])
    if capture_derivatives:
        trace.dx = np.array([np.asarray(system.flows[k](t, x), float) for t, x, k in zip(trace.t, trace.x, trace.location, strict=True)])
    return trace


def _simulate(system, span, x0, location, max_jumps, sample_dt, rtol, atol, max_step, sample_times) -> Trace:
    here, t, x = location or system.initial, span[0], np.asarray(x0, float)
    at = grid(*span, sample_dt) if sample_dt else None
    if sample_times is not None:
        at = np.asarray(sample_times, float)
        if sample_dt or not len(at) or at[0] != span[0] or (np.diff(at) <= 0).any() or at[-1] > span[1]:
            raise ValueError("sample times rise from the start of the span, and stand in for sample_dt")
    times, states, places, events, k = [t], [x], [here], [], 1
    while t < span[1]:
        jump = None
        for s in steps(system.flows[here], t, x, span[1], rtol, atol, max_step):
            hits = [(_root(s, tr), n, tr) for n, tr in enumerate(system.leaving(here)) if _crossed(tr.guard(s.t0, s.x0), tr.guard(s.t1, s.x1), tr.direction)]
            end = min(hits, key=lambda h: h[:2])[0] if hits else s.t1
            if at is None:
                times.append(end)
                states.append(s.at(end) if hits else s.x1)
                places.append(here)
            while at is not None and k < len(at) and at[k] <= end:
                times.append(at[k])
                states.append(s.at(at[k]))
                places.append(here)
                k += 1
            t, x = end, s.at(end) if hits else s.x1
            if hits:
                jump = min(hits, key=lambda h: h[:2])[2]
                break
        while jump is not None:
            if len(events) >= max_jumps:
                raise RuntimeError(f"more than {max_jumps} jumps")
            x = np.asarray(jump.reset(t, x), float)
            events.append(Event(t, jump.source, jump.target, x))
            here = jump.target
            # what the reset has already carried across a threshold is taken at once
            jump = next((tr for tr in system.leaving(here) if tr is not jump and tr.source != tr.target and tr.direction and tr.guard(t, x) * tr.direction > AFTER), None)
        t = min(t + AFTER, span[1]) if events and events[-1].time == t else t
    return Trace(np.array(times), np.array(states), places, events)


def bouncing_ball(gravity: float = 9.81, loss: float = 0.8) -> HybridSystem:
    """Height and speed; speed is reversed and reduced at the ground."""
    fall = lambda t, x: np.array([x[1], -gravity])
    hit = Transition("fall", "fall", lambda t, x: x[0], -1, lambda t, x: np.array([0.0, -loss * x[1]]))
    return HybridSystem({"fall": fall}, [hit], "fall")


def trace_columns(trace: Trace, states: Sequence[str], inputs: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """step, t, location, the states, their derivatives as dx_<state> and the inputs as u_<input>, as
    far as the trace has them."""
    out = {"step": np.arange(len(trace.t), dtype=np.int32), "t": trace.t, "location": np.array(trace.location, object)}
    out |= {name: trace.x[:, j] for j, name in enumerate(states)}
    if trace.dx is not None:
        out |= {f"dx_{name}": trace.dx[:, j] for j, name in enumerate(states)}
    if trace.u is not None:
        out |= {f"u_{name}": trace.u[:, j] for j, name in enumerate(inputs)}
    return out


def generate_runs(system: Callable[[], HybridSystem], starts: DataFrame, span: tuple[float, float], states: Sequence[str], inputs: Callable[[], Inputs] | None = None, input_names: Sequence[str] = (), derivatives: bool = False, **settings) -> DataFrame:
    """A trace for each row (trace_id, x0), in parallel, with derivatives and inputs as columns
    (trace_columns); system and inputs are built by each task."""
    names = [*states, *(f"dx_{s}" for s in states if derivatives), *(f"u_{i}" for i in input_names if inputs)]
    schema = "trace_id long, step int, t double, location string, " + ", ".join(f"`{n}` double" for n in names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, given = system(), inputs() if inputs else None
        for frame in frames:
            for row in frame.itertuples(index=False):
                trace = simulate(own, span, np.asarray(row.x0, float), inputs=given, capture_derivatives=derivatives, **settings)
                yield pd.DataFrame({"trace_id": row.trace_id, **trace_columns(trace, states, input_names)})

    spread = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), starts.sparkSession.sparkContext.defaultParallelism)
    return starts.select("trace_id", "x0").repartition(spread, "trace_id").mapInPandas(run, schema)


def generate_traces(system: Callable[[], HybridSystem], starts: DataFrame, span: tuple[float, float], dt: float, states: int) -> DataFrame:
    """A sampled trace for each row (trace_id, x0), in parallel; system is built by each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = system()
        for frame in frames:
            for row in frame.itertuples(index=False):
                trace = simulate(own, span, np.asarray(row.x0, float), sample_dt=dt)
                yield pd.DataFrame({"trace_id": row.trace_id, "step": np.arange(len(trace.t), dtype=np.int32), "t": trace.t, "location": trace.location, **{f"x{j}": trace.x[:, j] for j in range(states)}})

    # starts are small and their traces are not: a file of them must not be one task
    spread = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), starts.sparkSession.sparkContext.defaultParallelism)
    return starts.select("trace_id", "x0").repartition(spread, "trace_id").mapInPandas(run, trace_schema(states, ("location",)))
