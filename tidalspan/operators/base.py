"""Transforms: functions from DataFrame to DataFrame that can be fitted, chained and inverted."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame


class Transform(ABC):
    """Implement apply; fit and inverse only where they mean something."""

    @abstractmethod
    def apply(self, df: DataFrame) -> DataFrame: ...

    def fit(self, df: DataFrame) -> Transform:
        return self

    def fit_incremental(self, df: DataFrame) -> Transform:
        """By default as little happens as in fit; transforms that would need all data raise."""
        return self

    def inverse(self) -> Transform:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def chain(self, other: Transform) -> Transform:
        return Chain(self, other)

    def __or__(self, other: Transform) -> Transform:
        return self.chain(other)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


class Identity(Transform):
    def apply(self, df: DataFrame) -> DataFrame:
        return df

    def inverse(self) -> Transform:
        return self

    def chain(self, other: Transform) -> Transform:
        return other


class Chain(Transform):
    """Transforms one after another; nested chains are flattened."""

    def __init__(self, *parts: Transform) -> None:
        self.parts: tuple[Transform, ...] = ()
        for part in parts:
            self.parts += part.parts if isinstance(part, Chain) else (part,)

    def apply(self, df: DataFrame) -> DataFrame:
        for part in self.parts:
            df = part.apply(df)
        return df

    def fit(self, df: DataFrame) -> Chain:
        for part in self.parts:
            part.fit(df)
            df = part.apply(df)
        return self

    def fit_incremental(self, df: DataFrame) -> Chain:
        for part in self.parts:
            part.fit_incremental(df)
            df = part.apply(df)
        return self

    def inverse(self) -> Chain:
        return Chain(*(p.inverse() for p in reversed(self.parts)))


class Lambda(Transform):
    """A function of the frame, with its inverse if it has one; both survive pickling."""

    def __init__(self, function: Callable[[DataFrame], DataFrame], inverse: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.function, self.inverse_function = function, inverse

    def apply(self, df: DataFrame) -> DataFrame:
        return self.function(df)

    def inverse(self) -> Transform:
        if self.inverse_function is None:
            return super().inverse()
        return Lambda(self.inverse_function, self.function)

    def __getstate__(self) -> bytes:
        from pyspark import cloudpickle

        return cloudpickle.dumps((self.function, self.inverse_function))

    def __setstate__(self, state: bytes) -> None:
        self.function, self.inverse_function = pickle.loads(state)
