"""A recorder on a stream: holds the last seconds of each key until its flag turns on."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are handed on at a time.
PIECE = 10_000


def in_order(frames: Iterable[pd.DataFrame], order: str, names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch in order, PIECE at a time. Spark hands them over in frames that are
    cut by number of rows and are in no order, so all of the key's are held, as columns."""
    held = [frame[list(names)] for frame in frames]
    rows = (held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)).sort_values(order, kind="stable") if held else pd.DataFrame(columns=list(names))
    held.clear()
    for k in range(0, len(rows), PIECE):
        yield rows.iloc[k : k + PIECE]


SCHEMA = "key long, t double, value double, flag boolean"


def record(stream: DataFrame, window: float) -> DataFrame:
    """Rows of stream (SCHEMA), from `window` seconds before each key's first true flag on. State is
    one window of rows a key, and a flag after that; rows of a key are expected in order of t from one
    micro-batch to the next, and are sorted within each."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on, held = (state.get[0], deque(zip(*state.get[1:], strict=True))) if state.exists else (False, deque())
        for frame in in_order(frames, "t", ["t", "value", "flag"]):
            out = []
            for t, value, flag in frame.itertuples(index=False):
                if not on and flag:
                    on = True
                    out += [h for h in held if h[0] >= t - window]
                    held.clear()
                if on:
                    out.append((t, value, bool(flag)))
                    continue
                while held and held[0][0] < t - window:  # in order of time, so the old ones come first
                    held.popleft()
                held.append((t, value, bool(flag)))
            yield pd.DataFrame({"key": key[0], "t": [o[0] for o in out], "value": [o[1] for o in out], "flag": [o[2] for o in out]}).astype({"key": "int64", "t": "float64", "value": "float64", "flag": "bool"})
        columns = [list(c) for c in zip(*held, strict=True)] or [[], [], []]
        state.update((on, *columns))

    return stream.groupBy("key").applyInPandasWithState(step, SCHEMA, "on boolean, t array<double>, value array<double>, flag array<boolean>", "append", "NoTimeout")
