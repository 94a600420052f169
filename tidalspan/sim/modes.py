"""Mode identification: which of several dynamics made each row, and a model for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidalspan.ml.learners import SUFFIX, ClusterModel, Learner, LinearModel, LinearRegression, Model, NumpyModel, classification_tree
from tidalspan.sim.hybrid import Inputs, Trace
from tidalspan.sim.ode import grid, pieces, sampled, solve, spread
from tidalspan.sim.selector import details, tree_function
from tidalspan.sources.frames import with_row_number


def history_features(df: DataFrame, signals: Sequence[str], modes: Sequence[str], history: int, key: str, order: str) -> DataFrame:
    """Columns c_t_minus_1 ... c_t_minus_history within each trace; rows without full history go."""
    w = W.partitionBy(key).orderBy(order)
    made = {f"{c}_t_minus_{k}": F.lag(c, k).over(w) for k in range(1, history + 1) for c in (*signals, *modes)}
    return df.withColumns(made | {"_n": F.row_number().over(w)}).where(F.col("_n") > history).drop("_n")


def _passed(at: int, last: int, sure: Callable[[int], bool]) -> int:
    """The last window known to fit, when window at does, by doubled and halved steps.

    sure(k): the errors of the model of window k have squares that sum to less than the threshold's.
    Least squares errs on a smaller window by no more than this model does there, in the sum of
    squares, which no single error exceeds: so all windows before k fit as well.
    """
    if at == last or not sure(at):
        return at
    low, ahead = at, 1
    while low < last and sure(min(low + ahead, last)):
        low, ahead = min(low + ahead, last), 2 * ahead
    high = min(low + ahead, last + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sure(middle) else (low, middle)
    return low


def identify_modes(df: DataFrame, order: str, inputs: Sequence[str], output: str, start_width: int, step_width: int, threshold: float, learner: Learner | None = None, max_modes: int = 16) -> tuple[DataFrame, list[Model]]:
    """Labels rows (mode, -1 for none) and gives a model for each mode.

    The first unlabelled row opens a window of start_width rows in order, which grows by step_width
    while a model fitted to it errs by less than threshold; all unlabelled rows that the model fits
    get its mode, and it is refitted on them. Ends when all rows are labelled, a window fits
    nothing, or max_modes is reached. Each round is a few aggregations; rows stay distributed.
    Windows of least squares that are known to fit are passed over (_passed).
    """
    learner = learner or LinearRegression()
    rows = df.withColumn("mode", F.lit(-1)).withColumn("_at", F.col(order)).persist()
    models: list[Model] = []
    error = F.abs(F.col(f"`{output}`") - F.col(f"`{output}{SUFFIX}`"))

    def judged(model: Model, window: DataFrame) -> tuple[float, float]:
        """The largest error, and the root of the sum of squared ones."""
        row = model.predict(window).agg(F.max(error), F.sum(error * error)).first()
        return row[0] or 0.0, float(row[1] or 0.0) ** 0.5

    while len(models) < max_modes:
        free = with_row_number(rows.where("mode = -1"), "_at", "_n").persist()
        total = free.count()
        last = max(0, -(-(total - start_width) // step_width))  # the window that has all rows
        seen: dict[int, tuple[Model, float, float]] = {}

        def tried(k: int, free: DataFrame = free, seen: dict = seen) -> tuple[Model, float, float]:
            if k not in seen:
                window = free.where(F.col("_n") <= start_width + k * step_width)
                fitted = learner.learn(window, list(inputs), [output])
                seen[k] = (fitted, *judged(fitted, window))
            return seen[k]

        model, at = None, 0
        while at <= last and total:
            if tried(at)[1] >= threshold:
                break
            if type(learner) is LinearRegression:
                at = _passed(at, last, lambda k: tried(k)[2] < threshold / 2)
            model, at = tried(at)[0], at + 1
        free.unpersist()
        if model is None:
            break

        def label(frame: DataFrame, with_model: Model, number: int) -> DataFrame:
            fits = (F.col("mode") == -1) & (error < threshold)
            return with_model.predict(frame).withColumn("mode", F.when(fits, F.lit(number)).otherwise(F.col("mode"))).drop(f"{output}{SUFFIX}")

        number = len(models)
        before, rows = rows, label(rows, model, number).persist()
        models.append(learner.learn(rows.where(F.col("mode") == number), list(inputs), [output]))
        done = rows.where("mode = -1").isEmpty()
        before.unpersist()
        if done:
            break
    return rows.drop("_at"), models


def numeric(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    """A fitted model as a function of one row's inputs."""
    if isinstance(model, LinearModel):
        w = np.array([model.weights[o] for o in model.outputs])
        return lambda x: w[:, :-1] @ x + w[:, -1]
    if isinstance(model, NumpyModel):
        return lambda x: np.asarray(model.function(x[None, :]), float).reshape(-1)
    raise TypeError(f"{type(model).__name__} cannot be evaluated row by row")


def numeric_many(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    """numeric for many rows: the inputs and the results are columns."""
    if isinstance(model, LinearModel):
        w = np.array([model.weights[o] for o in model.outputs])
        return lambda x: w[:, :-1] @ x + w[:, -1:]
    if isinstance(model, NumpyModel):
        return lambda x: np.asarray(model.function(x.T), float).reshape(x.shape[1], -1).T
    raise TypeError(f"{type(model).__name__} cannot be evaluated row by row")


class ModeModel(Model):
    """A selector chooses a mode for each row, whose model predicts. With one mode there is nothing to
    select. Where the outputs are the derivatives of the states, in the states' order, the model
    can be integrated: its inputs are then the states, the system's inputs and the time t, by name."""

    def __init__(self, inputs, outputs, selector: Model | None, models: Sequence[Model], states: Sequence[str] = ()) -> None:
        super().__init__(inputs, outputs)
        if not models:
            raise ValueError("there are no modes")
        if selector is None and len(models) > 1:
            raise ValueError("several modes need a selector")
        self.selector, self.modes, self.states = selector, list(models), list(states)
        self.router = ClusterModel(inputs, outputs, "selected_mode", dict(enumerate(models)))

    def _predict(self, df):
        if self.selector is None:
            return self.router.predict(df.withColumn("selected_mode", F.lit(0)))
        chosen = self.selector.predict(df).withColumnRenamed(self.selector.predictions[0], "selected_mode")
        return self.router.predict(chosen.withColumn("selected_mode", F.col("selected_mode").cast("int")))

    def predict_with_diagnostics(self, df: DataFrame) -> DataFrame:
        """predict, and why: ready (rows whose selector inputs are all there), the leaf of the selector
        and the probability of each mode. Rows that are not ready have no prediction."""
        if self.selector is None:
            return self.predict(df).withColumns({"ready": F.lit(True), "leaf": F.lit(None).cast("double"), "mode_probabilities": F.array(F.lit(1.0))})
        known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in self.selector.inputs))
        told = details(self.selector, df.where(known))
        out = self.router.predict(told.withColumn("selected_mode", F.col("selected_mode").cast("int"))).withColumn("ready", F.lit(True))
        return out.unionByName(df.where(~known).withColumn("ready", F.lit(False)), allowMissingColumns=True)

    def _choose(self) -> Callable[[dict[str, float]], int]:
        if self.selector is None:
            return lambda row: 0
        decide, names, count = tree_function(self.selector.models[0]), self.selector.inputs, len(self.modes)

        def choose(row: dict[str, float]) -> int:
            if missing := [n for n in names if n not in row]:
                raise ValueError(f"the selector needs {missing}: only selectors without history can be integrated")
            mode = int(decide([row[n] for n in names]))
            if not 0 <= mode < count:
                raise ValueError(f"the selector names the unknown mode {mode}")
            return mode

        return choose

    def _integrable(self) -> None:
        if not self.states or len(self.states) != len(self.outputs):
            raise ValueError("name the states whose derivatives the outputs are")

    def stepper(self, inputs: Inputs | None = None, input_names: Sequence[str] = (), **settings) -> Callable[[float, np.ndarray, float], tuple[int, np.ndarray]]:
        """(t, state, dt) -> the mode at t and the state after dt in it; plain functions, fit for tasks."""
        self._integrable()
        choose, flows, states, names = self._choose(), [numeric(m) for m in self.modes], self.states, self.inputs

        def row(t: float, x: np.ndarray) -> dict[str, float]:
            given = np.asarray(inputs(t), float) if inputs else ()
            return {"t": t, **dict(zip(states, map(float, x), strict=True)), **dict(zip(input_names, map(float, given), strict=True))}

        def step(t: float, x: np.ndarray, dt: float) -> tuple[int, np.ndarray]:
            x = np.asarray(x, float)
            if not np.isfinite(t) or not np.isfinite(dt) or dt <= 0 or x.shape != (len(states),) or not np.isfinite(x).all():
                raise ValueError("time, step and state must be finite, and the step above 0")
            mode = choose(row(t, x))

            def flow(at: float, y: np.ndarray) -> np.ndarray:
                now = row(at, y)
                return flows[mode](np.array([now[n] for n in names]))

            return mode, solve(flow, t, x, t + dt, **settings)[1][-1]

        return step

    def predict_next_state(self, state: Sequence[float], t: float, dt: float, inputs: Inputs | None = None, input_names: Sequence[str] = (), **settings) -> np.ndarray:
        return self.stepper(inputs, input_names, **settings)(t, np.asarray(state, float), dt)[1]

    def simulate(self, span: tuple[float, float], x0: Sequence[float], sample_dt: float | None = None, sample_times: Sequence[float] | None = None, inputs: Inputs | None = None, input_names: Sequence[str] = (), **settings) -> Trace:
        """The mode is chosen anew at each sample and holds to the next; a sample's location is the
        mode that led to it (the first's, the one that it chooses)."""
        if (sample_dt is None) == (sample_times is None):
            raise ValueError("give sample_dt or sample_times")
        at = np.asarray(sample_times, float) if sample_times is not None else grid(*span, sample_dt)
        step = self.stepper(inputs, input_names, **settings)
        states, places = [np.asarray(x0, float)], []
        for a, b in zip(at, at[1:], strict=False):
            mode, after = step(float(a), states[-1], float(b - a))
            places += [f"mode_{mode}"] * (2 if not places else 1)
            states.append(after)
        u = np.array([np.asarray(inputs(t), float) for t in at]) if inputs else None
        return Trace(at, np.array(states), places or ["mode_0"] * len(at), [], u)

    def simulate_frame(self, starts: DataFrame, span: tuple[float, float], dt: float) -> DataFrame:
        """A trace for each row (trace_id, x0), in parallel: trace_id, step, t, location, the states."""
        self._integrable()
        choose, flows, at, names = self._choose(), [numeric_many(m) for m in self.modes], grid(*span, dt), self.states
        known = ["t", *names]
        single = self.selector is None
        schema = "trace_id long, step int, t double, location string, " + ", ".join(f"`{s}` double" for s in names)
        if missing := [n for n in self.inputs if n not in known]:
            raise KeyError(f"the model needs {missing}")
        taken = [len(known) - 1 - known[::-1].index(n) for n in self.inputs]

        def flow(mode: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
            return lambda t, x: flows[mode](np.vstack([np.broadcast_to(t, x.shape[1:])[None, :], x])[taken])

        def traces(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """States, and the modes that led to them, by time; x has a column a start."""
            states, led = [x], []
            for now, then in zip(at, at[1:], strict=False):
                if not np.isfinite(x).all():
                    raise ValueError("time, step and state must be finite, and the step above 0")
                modes = np.zeros(x.shape[1], int) if single else np.array([choose({"t": float(now), **dict(zip(names, c, strict=True))}) for c in x.T.tolist()])
                after = np.empty_like(x)
                for mode in np.unique(modes).tolist():
                    own = modes == mode
                    after[:, own] = sampled(flow(mode), np.array([now, then]), x[:, own], then)[-1]
                x = after
                states.append(x)
                led += [modes] * (1 if led else 2)
            return np.array(states), np.array(led)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for piece in pieces(frame, len(at)):
                    n, m = len(piece), len(at)
                    x0 = np.array([np.asarray(x, float) for x in piece["x0"]])
                    if x0.shape != (n, len(names)):
                        raise ValueError("a start has a number for each state")
                    states, led = traces(x0.T)
                    places = np.array([f"mode_{k}" for k in range(len(flows))], object)[led].T.ravel() if m > 1 else np.full(n, None, object)
                    made = {s: states[:, j].T.ravel() for j, s in enumerate(names)}
                    yield pd.DataFrame({"trace_id": np.repeat(piece["trace_id"].to_numpy(), m), "step": np.tile(np.arange(m, dtype=np.int32), n), "t": np.tile(at, n), "location": places, **made})

        return spread(starts).mapInPandas(run, schema)


def learn_hybrid(df: DataFrame, order: str, inputs: Sequence[str], output: str, selector_inputs: Sequence[str], states: Sequence[str] = (), **settings) -> ModeModel:
    """identify_modes, then a tree that tells the modes apart, if there are several."""
    rows, models = identify_modes(df, order, inputs, output, **settings)
    if len(models) == 1:
        return ModeModel(list(inputs), [output], None, models, states)
    selector = classification_tree().learn(rows.where("mode >= 0"), list(selector_inputs), ["mode"])
    return ModeModel(list(inputs), [output], selector, models, states)
