"""Projections, renames, casts, predicates and reshaping of rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalspan import types
from tidalspan.functions.predicate import compile_predicate
from tidalspan.operators.base import Transform


def _names(*features: str | Iterable[str]) -> list[str]:
    out: list[str] = []
    for f in features:
        out += [f] if isinstance(f, str) else list(f)
    return out


class Select(Transform):
    """Columns by name, by a pattern written ^...$, or as expressions."""

    def __init__(self, features: str | Column | Iterable[str | Column]) -> None:
        self.features = [features] if isinstance(features, str | Column) else list(features)

    def apply(self, df: DataFrame) -> DataFrame:
        out: list = []
        for f in self.features:
            if isinstance(f, str) and f.startswith("^") and f.endswith("$"):
                out += [F.col(f"`{c}`") for c in df.columns if re.fullmatch(f, c)]
            elif isinstance(f, str):
                types.require(df, [f])
                out.append(F.col(f"`{f}`"))
            else:
                out.append(f)
        return df.select(*out)


class Drop(Transform):
    def __init__(self, features: str | Iterable[str], *more: str) -> None:
        self.features = _names(features, more)

    def apply(self, df: DataFrame) -> DataFrame:
        types.require(df, self.features)
        return df.drop(*self.features)


class Rename(Transform):
    def __init__(self, mapping: Mapping[str, str]) -> None:
        self.mapping = dict(mapping)

    def apply(self, df: DataFrame) -> DataFrame:
        types.require(df, self.mapping)
        return df.withColumnsRenamed(self.mapping)

    def inverse(self) -> Transform:
        return Rename({new: old for old, new in self.mapping.items()})


class Cast(Transform):
    """Strict casts: of all columns, of the named ones, or each to its own type."""

    def __init__(self, target: str | T.DataType | Mapping[str, str | T.DataType], features: Iterable[str] | None = None) -> None:
        self.target = dict(target) if isinstance(target, Mapping) else target
        self.features = list(features) if features is not None else None

    def apply(self, df: DataFrame) -> DataFrame:
        wanted = self.target if isinstance(self.target, dict) else dict.fromkeys(self.features or df.columns, self.target)
        types.require(df, wanted)
        return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in wanted.items()})


class Filter(Transform):
    """Keeps rows for which a condition holds: text, a Column or And, Or, Not of such."""

    def __init__(self, condition: str | Column | Filter) -> None:
        self.condition = condition

    def column(self, columns: list[str]) -> Column:
        return as_column(self.condition, columns)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.column(df.columns))


def as_column(condition: str | Column | Filter, columns: list[str]) -> Column:
    if isinstance(condition, Filter):
        return condition.column(columns)
    return compile_predicate(condition, columns) if isinstance(condition, str) else condition


class And(Filter):
    def __init__(self, conditions: str | Column | Filter | Iterable[str | Column | Filter]) -> None:
        self.conditions = [conditions] if isinstance(conditions, str | Column | Filter) else list(conditions)

    def column(self, columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (as_column(c, columns) for c in self.conditions))


class Or(And):
    def column(self, columns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (as_column(c, columns) for c in self.conditions))


class Not(Filter):
    def column(self, columns: list[str]) -> Column:
        return ~as_column(self.condition, columns)


class Unnest(Transform):
    """Structs to columns, in place."""

    def __init__(self, features: str | Iterable[str]) -> None:
        self.features = _names(features)

    def apply(self, df: DataFrame) -> DataFrame:
        types.require(df, self.features)
        out = []
        for c in df.columns:
            out += [F.col(f"`{c}`.`{f}`").alias(f) for f in df.schema[c].dataType.names] if c in self.features else [F.col(f"`{c}`")]
        return df.select(*out)


class Explode(Transform):
    """Arrays to rows, in lock-step; an empty array gives a row of nulls. Without names, all columns."""

    def __init__(self, features: str | Iterable[str] | None = None, *more: str) -> None:
        self.features = None if features is None else _names(features, more)

    def apply(self, df: DataFrame) -> DataFrame:
        names = self.features or df.columns
        types.require(df, names)
        zipped = F.arrays_zip(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
        at = {c: f"c{k}" for k, c in enumerate(names)}
        rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
        rows = df.select(*rest, F.explode_outer(zipped).alias("_row"))
        return rows.select(*(F.col(f"_row.{at[c]}").alias(c) if c in at else F.col(f"`{c}`") for c in df.columns))


class ExplodeTimeSeries(Transform):
    """A series to rows with its time and value; a struct value becomes columns."""

    def __init__(self, column: str) -> None:
        self.column = column

    def apply(self, df: DataFrame) -> DataFrame:
        kind = types.value_type(df, self.column)
        rest = [F.col(f"`{c}`") for c in df.columns if c != self.column]
        rows = df.select(*rest, F.explode_outer(F.col(f"`{self.column}`")).alias("_x"))
        if isinstance(kind, T.StructType):
            found = [F.col(f"_x.value.`{f}`").alias(f) for f in kind.names]
        else:
            found = [F.col("_x.value").alias("value")]
        return rows.select(*rest, F.col("_x.time").alias("time"), *found)


class Collapse(Transform):
    """A series to one of its values."""

    def __init__(self, feature: str, element: int = 0) -> None:
        self.feature, self.element = feature, element

    def apply(self, df: DataFrame) -> DataFrame:
        types.chosen_series(df, [self.feature])
        return df.withColumn(self.feature, F.get(F.col(self.feature), F.lit(self.element))["value"])


class CrossProduct(Transform):
    """Every combination of the frame's rows with those of small sides (discrete domains)."""

    def __init__(self, *sides: DataFrame) -> None:
        self.sides = sides

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(lambda a, b: a.crossJoin(b), self.sides, df)
