"""Learners and models. A model appends prediction columns; it never gives a frame of its own, so
rows keep their keys. Outputs are predicted as <output>_predicted unless named otherwise."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalspan.operators.base import Identity, Transform

SUFFIX = "_predicted"


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), str(path))


class Model:
    """pre is applied before prediction, post after it."""

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str]) -> None:
        self.inputs, self.outputs = list(inputs), list(outputs)
        self.pre: Transform = Identity()
        self.post: Transform = Identity()

    def name(self) -> str:
        return type(self).__name__

    @property
    def predictions(self) -> list[str]:
        return [f"{o}{SUFFIX}" for o in self.outputs]

    def _predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        return self.post.apply(self._predict(self.pre.apply(df)))

    def save(self, path: str) -> None:
        """To a file: a local path, or a URI of any file system that pyarrow knows."""
        system, at = _file(path)
        with system.open_output_stream(at) as f:
            f.write(pickle.dumps(self))

    @staticmethod
    def load(path: str) -> Model:
        system, at = _file(path)
        with system.open_input_stream(at) as f:
            return pickle.loads(f.read())


class Learner:
    def learn(self, df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> Model:
        raise NotImplementedError


class Callbacks:
    """Told of a learner's start, progress, end and errors; does nothing by itself."""

    def on_start(self, learner: object) -> None: ...
    def on_progress(self, learner: object, done: float | None, metrics: dict | None = None) -> None: ...
    def on_end(self, learner: object) -> None: ...
    def on_error(self, learner: object, error: BaseException) -> None: ...


class LoggingCallbacks(Callbacks):
    def __init__(self, logger=None) -> None:
        import logging

        self.logger = logger or logging.getLogger(__name__)

    def on_start(self, learner):
        self.logger.info("%s starts", type(learner).__name__)

    def on_progress(self, learner, done, metrics=None):
        self.logger.info("%s at %s %s", type(learner).__name__, f"{done:.0%}" if done is not None else "?", metrics or "")

    def on_end(self, learner):
        self.logger.info("%s is done", type(learner).__name__)

    def on_error(self, learner, error):
        self.logger.error("%s failed: %s", type(learner).__name__, error)


class ProgressCallbacks(Callbacks):
    """A line on a terminal that follows a learner."""

    def __init__(self, out=None, width: int = 30) -> None:
        import sys

        self.out, self.width = out or sys.stderr, width

    def _line(self, learner, text: str, end: str = "") -> None:
        self.out.write(f"\r{type(learner).__name__} {text}{end}")
        self.out.flush()

    def on_start(self, learner):
        self._line(learner, "...")

    def on_progress(self, learner, done, metrics=None):
        bar = "?" * self.width if done is None else ("#" * round(done * self.width)).ljust(self.width, ".")
        self._line(learner, f"[{bar}] {' '.join(f'{k}={v:.4g}' for k, v in (metrics or {}).items())}")

    def on_end(self, learner):
        self._line(learner, "done", "\n")

    def on_error(self, learner, error):
        self._line(learner, f"failed: {error}", "\n")


def told(callbacks: Sequence[Callbacks], learner: object, work: Callable[[], Model]) -> Model:
    for c in callbacks:
        c.on_start(learner)
    try:
        model = work()
    except Exception as e:
        for c in callbacks:
            c.on_error(learner, e)
        raise
    for c in callbacks:
        c.on_end(learner)
    return model


class LinearModel(Model):
    """Weights as plain expressions: prediction stays inside code generation."""

    def __init__(self, inputs, outputs, weights: dict[str, list[float]]) -> None:
        super().__init__(inputs, outputs)
        self.weights = weights  # of each output: one an input, then the intercept

    def _predict(self, df):
        made = {}
        for o in self.outputs:
            *w, b = self.weights[o]
            made[f"{o}{SUFFIX}"] = reduce(lambda a, t: a + t, (F.col(f"`{c}`") * k for c, k in zip(self.inputs, w, strict=True)), F.lit(b))
        return df.withColumns(made)


class LinearRegression(Learner):
    """Least squares from centred moments, in two aggregations: means first, so that inputs far from
    zero (times in seconds since 1970, say) lose no digits, then products of what is left. Inputs
    are scaled to unit deviation before the equations are solved; constant ones get weight 0."""

    def learn(self, df, inputs, outputs):
        names = [*inputs, *outputs]
        n, known = len(inputs), df.select(*(F.col(f"`{c}`").cast("double").alias(f"_c{k}") for k, c in enumerate(names))).dropna()
        means = known.agg(*(F.avg(f"_c{k}") for k in range(len(names)))).first()
        if means[0] is None:
            return LinearModel(inputs, outputs, {o: [0.0] * (n + 1) for o in outputs})
        term = lambda k: F.col(f"_c{k}") - F.lit(means[k])
        pairs = [(i, j) for i in range(n) for j in range(i, len(names))]
        row = known.agg(*(F.avg(term(i) * term(j)) for i, j in pairs)).first()
        found = {p: row[k] for k, p in enumerate(pairs)}
        scale = np.array([np.sqrt(found[i, i]) or 1.0 for i in range(n)])
        gram = np.array([[found[min(i, j), max(i, j)] / (scale[i] * scale[j]) for j in range(n)] for i in range(n)])
        weights = {}
        for k, o in enumerate(outputs):
            w = np.linalg.lstsq(gram, np.array([found[i, n + k] for i in range(n)]) / scale, rcond=1e-12)[0] / scale
            weights[o] = [*w.tolist(), float(means[n + k] - w @ np.array(means[:n]))]
        return LinearModel(inputs, outputs, weights)


class MlModel(Model):
    """A fitted pyspark.ml model for each output."""

    def __init__(self, inputs, outputs, models: list, probability: bool = False, threshold: float | None = None) -> None:
        super().__init__(inputs, outputs)
        self.models, self.probability, self.threshold = models, probability, threshold

    def _predict(self, df):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        df = VectorAssembler(inputCols=self.inputs, outputCol="_features", handleInvalid="keep").transform(df)
        for o, m in zip(self.outputs, self.models, strict=True):
            df = m.transform(df)
            if self.probability:
                share = F.get(vector_to_array(F.col("_probability")), F.lit(1))
                df = df.withColumn(f"{o}_probability", share)
                if self.threshold is not None:
                    df = df.withColumn(f"_p_{o}", (share >= self.threshold).cast("double"))
                df = df.drop("_probability", "_raw")
            df = df.withColumnRenamed(f"_p_{o}", f"{o}{SUFFIX}")
        return df.drop("_features")

    def save(self, path: str) -> None:
        from pyspark.ml import PipelineModel
        from pyspark.sql import SparkSession

        PipelineModel(stages=self.models).write().overwrite().save(f"{path}/models")
        about = pickle.dumps((self.inputs, self.outputs, self.probability, self.threshold, self.pre, self.post)).hex()
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str) -> MlModel:
        from pyspark.ml import PipelineModel
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        inputs, outputs, probability, threshold, pre, post = pickle.loads(bytes.fromhex(spark.read.text(f"{path}/about").first()["value"]))
        made = MlModel(inputs, outputs, PipelineModel.load(f"{path}/models").stages, probability, threshold)
        made.pre, made.post = pre, post
        return made


class MlLearner(Learner):
    """Any pyspark.ml regressor or classifier, one fit an output."""

    def __init__(self, estimator: Callable[[], object], classifier: bool = False, threshold: float | None = None, callbacks: Sequence[Callbacks] = ()) -> None:
        self.estimator, self.classifier, self.threshold, self.callbacks = estimator, classifier, threshold, callbacks

    def learn(self, df, inputs, outputs):
        return told(self.callbacks, self, lambda: self._learn(df, inputs, outputs))

    def _learn(self, df, inputs, outputs):
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=list(inputs), outputCol="_features", handleInvalid="skip").transform(df)
        models = []
        for o in outputs:
            e = self.estimator().setFeaturesCol("_features").setLabelCol("_label").setPredictionCol(f"_p_{o}")
            if self.classifier:
                e = e.setProbabilityCol("_probability").setRawPredictionCol("_raw")
            models.append(e.fit(rows.select("_features", F.col(f"`{o}`").cast("double").alias("_label"))))
        return MlModel(list(inputs), list(outputs), models, self.classifier, self.threshold)


def regression_tree(max_depth: int = 5, seed: int = 1, **kw) -> MlLearner:
    from pyspark.ml.regression import DecisionTreeRegressor

    return MlLearner(lambda: DecisionTreeRegressor(maxDepth=max_depth, seed=seed), **kw)


def random_forest(trees: int = 20, max_depth: int = 5, seed: int = 1, **kw) -> MlLearner:
    from pyspark.ml.regression import RandomForestRegressor

    return MlLearner(lambda: RandomForestRegressor(numTrees=trees, maxDepth=max_depth, seed=seed), **kw)


def boosted_regressor(rounds: int = 20, max_depth: int = 5, seed: int = 1, **kw) -> MlLearner:
    from pyspark.ml.regression import GBTRegressor

    return MlLearner(lambda: GBTRegressor(maxIter=rounds, maxDepth=max_depth, seed=seed), **kw)


def boosted_classifier(rounds: int = 20, max_depth: int = 5, seed: int = 1, threshold: float | None = None, **kw) -> MlLearner:
    from pyspark.ml.classification import GBTClassifier

    return MlLearner(lambda: GBTClassifier(maxIter=rounds, maxDepth=max_depth, seed=seed), classifier=True, threshold=threshold, **kw)


def classification_tree(max_depth: int = 5, seed: int = 1, **kw) -> MlLearner:
    from pyspark.ml.classification import DecisionTreeClassifier

    return MlLearner(lambda: DecisionTreeClassifier(maxDepth=max_depth, seed=seed), classifier=True, **kw)


class NumpyModel(Model):
    """A vectorised function of input matrices, run on Arrow batches."""

    def __init__(self, inputs, outputs, function: Callable[[np.ndarray], np.ndarray]) -> None:
        super().__init__(inputs, outputs)
        self.function = function

    def _predict(self, df):
        names, made, function = self.inputs, self.predictions, self.function
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in made)])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = np.asarray(function(frame[names].to_numpy(np.float64))).reshape(len(frame), -1)
                yield frame.assign(**{c: out[:, k] for k, c in enumerate(made)})

        return df.mapInPandas(run, schema)


class Perceptron:
    """Weights of a multi-layer perceptron with ReLU layers."""

    def __init__(self, sizes: Sequence[int], seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k < len(self.w) - 1 else z)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[list, list, float]:
        out = self.layers(x)
        delta = 2 * (out[-1] - y) / y.size
        loss, gw, gb = float(((out[-1] - y) ** 2).mean()), [], []
        for k in range(len(self.w) - 1, -1, -1):
            gw.insert(0, out[k].T @ delta)
            gb.insert(0, delta.sum(axis=0))
            delta = (delta @ self.w[k].T) * (out[k] > 0)
        return gw, gb, loss


#: Bytes of rows that the driver takes over all epochs, and how many times held rows a task takes.
SENT, TASK = 64_000_000, 10


def _held(blocks: Iterable[np.ndarray], held: int) -> Iterator[np.ndarray]:
    """Blocks of rows as matrices of held rows; the last one has what is left."""
    kept, n = [], 0
    for block in blocks:
        while n + len(block) > held:
            yield np.concatenate([*kept, block[: held - n]])
            kept, n, block = [], 0, block[held - n :]
        kept.append(block)
        n += len(block)
    if n:
        yield np.concatenate(kept)


class _Fit:
    """A perceptron with Adam's moments, at some step of its training."""

    def __init__(self, net: Perceptron, seed: int, batch: int, inputs: int) -> None:
        self.net, self.rng, self.batch, self.inputs = net, np.random.default_rng(seed), batch, inputs
        self.m, self.v = ([np.zeros_like(p) for p in (*net.w, *net.b)] for _ in range(2))
        self.t = 0

    def start(self, rate: float) -> None:
        """An epoch."""
        self.rate, self.total, self.steps = rate, 0.0, 0

    def take(self, chunk: np.ndarray) -> None:
        """Steps over the rows of a chunk, in random order."""
        x, y, m, v, params = chunk[:, : self.inputs], chunk[:, self.inputs :], self.m, self.v, [*self.net.w, *self.net.b]
        order = self.rng.permutation(len(x))
        for at in range(0, len(x), self.batch):
            part = order[at : at + self.batch]
            gw, gb, loss = self.net.gradient(x[part], y[part])
            self.total, self.steps, self.t = self.total + loss, self.steps + 1, self.t + 1
            for k, g in enumerate([*gw, *gb]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= self.rate * (m[k] / (1 - 0.9**self.t)) / (np.sqrt(v[k] / (1 - 0.999**self.t)) + 1e-8)


class MlpLearner(Learner):
    """Perceptron fitted by Adam with a cosine rate and early stopping, on all rows. The driver takes
    the steps and holds about held rows at a time, and a partition; more rows are streamed to it in
    each epoch, ordered by a hash that differs between epochs, and are shuffled among those held.
    Where that would be more than SENT bytes, tasks take the steps, one after another: each gets the
    weights and Adam's moments from the one before and takes the rows of its part of the hashes."""

    def __init__(self, hidden: Sequence[int] = (10, 10), epochs: int = 100, rate: float = 1e-2, batch: int = 32, patience: int = 10, held: int = 100_000, seed: int = 1, callbacks: Sequence[Callbacks] = ()) -> None:
        self.hidden, self.epochs, self.rate, self.batch, self.patience, self.held, self.seed, self.callbacks = hidden, epochs, rate, batch, patience, held, seed, callbacks

    def learn(self, df, inputs, outputs):
        return told(self.callbacks, self, lambda: self._learn(df, list(inputs), list(outputs)))

    def _chunks(self, rows: DataFrame, epoch: int) -> Iterator[np.ndarray]:
        """All rows as matrices of about held rows."""
        names = rows.columns

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = np.column_stack([batch.column(k).to_numpy() for k in range(len(names))])
                yield pa.record_batch([pa.array([block.tobytes()])], names=["block"])

        ordered = rows.orderBy(F.xxhash64(*names, *([F.lit(epoch)] if epoch else [])), *names)
        yield from _held((np.frombuffer(r["block"], np.float64).reshape(-1, len(names)) for r in ordered.mapInArrow(pack, "block binary").toLocalIterator()), self.held)

    def _parts(self, rows: DataFrame, epoch: int, n: int) -> RDD:
        """An RDD of blocks of rows, cut and ordered by the hash of an epoch: TASK * held rows a partition."""
        names = rows.columns
        count = -(-n // (TASK * self.held))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = np.column_stack([batch.column(k).to_numpy() for k in range(len(names))])
                yield pa.record_batch([pa.array([block.tobytes()])], names=["block"])

        hashed = rows.withColumn("_hash", F.xxhash64(*names, F.lit(epoch)))
        part = F.least(F.floor((F.col("_hash") / 2.0**64 + 0.5) * count), F.lit(count - 1)).cast("int")
        dealt = hashed.repartitionById(count, part).sortWithinPartitions("_hash", *names).select(*names)
        return dealt.mapInArrow(pack, "block binary").rdd

    def _learn(self, df, inputs, outputs):
        names = [f"_c{k}" for k in range(len(inputs) + len(outputs))]
        rows = df.select(*(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip([*inputs, *outputs], names, strict=True))).dropna()
        fit = _Fit(Perceptron([len(inputs), *self.hidden, len(outputs)], self.seed), self.seed, self.batch, len(inputs))
        best, waited, whole = np.inf, 0, None
        n = rows.count()
        far = n > self.held and n * len(names) * 8 * self.epochs > SENT
        for epoch in range(self.epochs):
            fit.start(self.rate * 0.5 * (1 + np.cos(np.pi * epoch / self.epochs)))
            if far:
                parts, held = self._parts(rows, epoch, n), self.held
                for k in range(parts.getNumPartitions()):

                    def run(found, fit=fit, width=len(names)):
                        for chunk in _held((np.frombuffer(r["block"], np.float64).reshape(-1, width) for r in found), held):
                            fit.take(chunk)
                        return [fit]

                    [fit] = rows.sparkSession.sparkContext.runJob(parts, run, [k])
            else:
                chunks = 0
                for chunk in self._chunks(rows, epoch) if whole is None else [whole]:
                    chunks += 1
                    fit.take(chunk)
                if chunks == 1:
                    whole = chunk  # all rows: they stay
            loss = fit.total / fit.steps if fit.steps else 0.0
            for c in self.callbacks:
                c.on_progress(self, (epoch + 1) / self.epochs, {"train_loss": loss})
            best, waited = (loss, 0) if loss < best - 1e-9 else (best, waited + 1)
            if waited >= self.patience:
                break
        return NumpyModel(inputs, outputs, fit.net)


class IncrementalLinear(Learner):
    """Linear regression by gradient steps: one a batch, whose gradient is one aggregation, or one a
    row in the frame's order, for which rows pass through the driver, a partition at a time."""

    def __init__(self, rate: float = 0.01, per_row: bool = False) -> None:
        self.rate, self.per_row, self.weights = rate, per_row, None

    def learn_incremental(self, df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> LinearModel:
        inputs, outputs = list(inputs), list(outputs)
        if self.weights is None:
            self.weights = np.zeros((len(inputs) + 1, len(outputs)))
        rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"_c{k}") for k, c in enumerate([*inputs, *outputs]))).dropna()
        (self._rows if self.per_row else self._batch)(rows, len(inputs))
        return LinearModel(inputs, outputs, {o: self.weights[:, k].tolist() for k, o in enumerate(outputs)})

    def _batch(self, rows: DataFrame, n: int) -> None:
        x = [*(F.col(f"_c{k}") for k in range(n)), F.lit(1.0)]
        sums = []
        for o in range(self.weights.shape[1]):
            error = reduce(lambda a, b: a + b, (c * float(w) for c, w in zip(x, self.weights[:, o], strict=True))) - F.col(f"_c{n + o}")
            sums += [F.avg(error * c) for c in x]
        row = rows.agg(*sums).first()
        if row[0] is not None:
            self.weights -= self.rate * 2 * np.array(row, float).reshape(self.weights.shape[1], n + 1).T

    def _rows(self, rows: DataFrame, n: int) -> None:
        names = rows.columns

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array([np.column_stack([batch.column(k).to_numpy() for k in range(len(names))]).tobytes()])], names=["block"])

        for r in rows.mapInArrow(pack, "block binary").toLocalIterator():
            block = np.frombuffer(r["block"], np.float64).reshape(-1, len(names))
            x = np.hstack([block[:, :n], np.ones((len(block), 1))])
            for given, wanted in zip(x, block[:, n:], strict=True):
                self.weights -= self.rate * 2 * np.outer(given, given @ self.weights - wanted)

    def learn(self, df, inputs, outputs):
        return self.learn_incremental(df, inputs, outputs)


class DummyModel(Model):
    def _predict(self, df):
        return df.withColumns({c: F.lit(0.0) for c in self.predictions})


class DummyLearner(Learner):
    def learn(self, df, inputs, outputs):
        return DummyModel(inputs, outputs)


class EnsembleModel(Model):
    """The sum of its models' predictions."""

    def __init__(self, inputs, outputs, models: Sequence[Model]) -> None:
        super().__init__(inputs, outputs)
        self.models = list(models)

    def _predict(self, df):
        for k, m in enumerate(self.models):
            df = m.predict(df).withColumnsRenamed({p: f"_e{k}_{o}" for p, o in zip(m.predictions, m.outputs, strict=True)})
        made = {f"{o}{SUFFIX}": reduce(lambda a, b: a + b, (F.col(f"`_e{k}_{m.outputs[i]}`") for k, m in enumerate(self.models))) for i, o in enumerate(self.outputs)}
        return df.withColumns(made).drop(*(f"_e{k}_{o}" for k, m in enumerate(self.models) for o in m.outputs))


class EnsembleLearner(Learner):
    """Each learner is fitted to what those before it leave over."""

    def __init__(self, *learners: Learner) -> None:
        self.learners = learners

    def learn(self, df, inputs, outputs):
        models, rest = [], df.withColumns({f"_r_{o}": F.col(f"`{o}`") for o in outputs})
        targets = [f"_r_{o}" for o in outputs]
        for learner in self.learners:
            m = learner.learn(rest, inputs, targets)
            models.append(m)
            rest = m.predict(rest).withColumns({t: F.col(f"`{t}`") - F.col(f"`{t}{SUFFIX}`") for t in targets}).drop(*m.predictions)
        return EnsembleModel(inputs, outputs, models)


class ClusterModel(Model):
    """Routes each row to the model of its label; rows with an unknown label get null."""

    def __init__(self, inputs, outputs, label: str, models: dict) -> None:
        super().__init__(inputs, outputs)
        self.label, self.models = label, models

    def _predict(self, df):
        if all(isinstance(m, LinearModel) for m in self.models.values()):
            made = {}
            for o in self.outputs:
                value = F.lit(None).cast("double")
                for k, m in self.models.items():
                    *w, b = m.weights[o]
                    linear = reduce(lambda a, t: a + t, (F.col(f"`{c}`") * x for c, x in zip(m.inputs, w, strict=True)), F.lit(b))
                    value = F.when(F.col(self.label) == F.lit(k), linear).otherwise(value)
                made[f"{o}{SUFFIX}"] = value
            return df.withColumns(made)
        known = list(self.models)
        parts = [m.predict(df.where(F.col(self.label) == F.lit(k))) for k, m in self.models.items()]
        rest = df.where(~F.coalesce(F.col(self.label).isin(known), F.lit(False))).withColumns({c: F.lit(None).cast("double") for c in self.predictions})
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, rest])


class ClusterLearner(Learner):
    """A model for each label."""

    def __init__(self, learner: Learner, label: str = "cluster_label") -> None:
        self.learner, self.label = learner, label

    def learn(self, df, inputs, outputs):
        labels = sorted(r[0] for r in df.select(self.label).where(F.col(self.label).isNotNull()).distinct().collect())  # few, by design
        features = [i for i in inputs if i != self.label]
        return ClusterModel(features, outputs, self.label, {k: self.learner.learn(df.where(F.col(self.label) == F.lit(k)), features, outputs) for k in labels})
