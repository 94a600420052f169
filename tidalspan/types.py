"""The time series type: an array of structs with fields time and value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidalspan.errors import FeatureNotFoundError, NoTimeSeriesFeatureError


def series_type(time: T.DataType | None = None, value: T.DataType | None = None) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("time", time or T.DoubleType()), T.StructField("value", value or T.DoubleType())]))


def is_series(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"time", "value"} <= set(kind.elementType.names)


def series_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_series(f.dataType)]


def value_type(df: DataFrame, column: str) -> T.DataType:
    return _element(df, column)["value"].dataType


def time_type(df: DataFrame, column: str) -> T.DataType:
    return _element(df, column)["time"].dataType


def _element(df: DataFrame, column: str) -> T.StructType:
    require(df, [column])
    kind = df.schema[column].dataType
    if not is_series(kind):
        raise NoTimeSeriesFeatureError(f"{column} is no time series")
    return kind.elementType


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raises for columns that df does not have."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise FeatureNotFoundError(f"no such columns: {missing}")


def chosen_series(df: DataFrame, features: str | Iterable[str] | None) -> list[str]:
    """The named series, or all of df; raises if there is none or a name is no series."""
    if features is None:
        found = series_columns(df)
        if not found:
            raise NoTimeSeriesFeatureError("there is no time series column")
        return found
    names = [features] if isinstance(features, str) else list(features)
    for name in names:
        _element(df, name)
    return names
