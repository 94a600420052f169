"""Learning from and predicting on streams, retention before a trigger, stateful mode selection."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidalspan.errors import StopLearning
from tidalspan.ml.learners import Model
from tidalspan.operators.base import Identity, Transform
from tidalspan.streaming.retention import in_order


def learn_stream(stream: DataFrame, learner, inputs: Sequence[str], outputs: Sequence[str], transform: Transform | None = None, checkpoint: str | None = None) -> int:
    """One step of the learner a micro-batch, over all that the source has now; the learner keeps its
    state on the driver. Returns the number of rows seen."""
    change, seen, model = transform or Identity(), [0], [None]

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        n = batch.count()
        if n:
            change.fit_incremental(batch)
            try:
                model[0] = learner.learn_incremental(change.apply(batch), list(inputs), list(outputs))
            except StopLearning:
                pass
            seen[0] += n
        batch.unpersist()

    shared = stream.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not checkpoint and shared:  # not a folder of the driver's own
        checkpoint = f"{shared.rstrip('/')}/learning-{uuid.uuid4().hex}"
    writer = stream.writeStream.foreachBatch(step).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    learner.model = model[0]
    return seen[0]


def predict_stream(stream: DataFrame, model: Model, path: str, transform: Transform | None = None) -> None:
    """Predictions of all that the source has now, appended exactly once under path."""
    out = model.predict((transform or Identity()).apply(stream))
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def recorded(df: DataFrame, key: str, time: str, flag: str, window: float) -> DataFrame:
    """Rows kept by a recorder that holds the last `window` seconds until the flag turns on, and all
    rows from then on; one aggregation by key."""
    first = df.where(F.col(flag)).groupBy(key).agg(F.min(time).alias("_on"))
    return df.join(first, key).where(F.col(time) >= F.col("_on") - window).drop("_on")


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Event-time counts with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def select_modes(df: DataFrame, key: str, order: str, features: Sequence[str], history: int, bootstrap: str, decide) -> DataFrame:
    """Autoregressive mode selection: each row's mode follows from its features and those of the
    rows before it together with the modes selected for them. The first rows of a trace take theirs
    from the column bootstrap. decide: (samples with the present one last, modes before) -> mode.
    Sequential within a trace, parallel over traces; a trace is held row by row."""
    schema = T.StructType([*df.schema.fields, T.StructField("selected_mode", T.LongType())])

    def run(trace: pd.DataFrame) -> pd.DataFrame:
        trace = trace.sort_values(order)
        samples, modes = trace[list(features)].to_numpy(), []
        for k, given in enumerate(trace[bootstrap]):
            if k < history:
                modes.append(int(given))
            else:
                modes.append(int(decide(samples[k - history : k + 1], modes[k - history : k])))
        return trace.assign(selected_mode=modes)

    return df.groupBy(key).applyInPandas(run, schema)


def select_modes_on_stream(stream: DataFrame, features: Sequence[str], history: int, decide) -> DataFrame:
    """select_modes on a stream of rows (key, t, the features, mode): state is the last history
    samples and selected modes of each key, whatever the length of a trace. Rows of a key are
    expected in order of t from one micro-batch to the next, and are sorted within each. mode gives the first modes of a trace; a row is ready after them."""
    names = list(features)
    schema = "key long, t double, " + "".join(f"`{c}` double, " for c in names) + "selected_mode long, ready boolean"

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        samples, modes = (deque(map(list, state.get[0])), deque(state.get[1])) if state.exists else (deque(), deque())
        for frame in in_order(frames, "t", ["key", "t", *names, "mode"]):
            chosen, ready = [], []
            for given, sample in zip(frame["mode"], frame[names].to_numpy(float).tolist(), strict=True):
                ready.append(len(modes) >= history)
                mode = int(decide([*samples, sample], list(modes))) if ready[-1] else int(given)
                chosen.append(mode)
                samples.append(sample)
                modes.append(mode)
                while len(modes) > history:
                    samples.popleft()
                    modes.popleft()
            yield frame.assign(selected_mode=chosen, ready=ready)[["key", "t", *names, "selected_mode", "ready"]]
        state.update(([list(s) for s in samples], list(modes)))

    return stream.groupBy("key").applyInPandasWithState(step, schema, "samples array<array<double>>, modes array<long>", "append", "NoTimeout")


def changes(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Rows at which the flag of a key is not what it was in the row before; a first row is a change."""
    before = F.lag(flag).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("_before", before).where(~F.col(flag).eqNullSafe(F.col("_before"))).drop("_before")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
