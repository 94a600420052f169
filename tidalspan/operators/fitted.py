"""Transforms that learn something from the data: one aggregation in fit, lazy application."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalspan import types
from tidalspan.errors import NoCategoriesError, NoMatchingCategoryError, NotFittedError
from tidalspan.operators.base import Transform


class Standardize(Transform):
    """(x - mean) / std for all columns, or those of the given means; a std of 0 or null counts as 1."""

    def __init__(self, mean: Mapping[str, float] | None = None, std: Mapping[str, float] | None = None) -> None:
        self.mean, self.std = dict(mean) if mean else None, dict(std) if std else None

    def fit(self, df: DataFrame) -> Standardize:
        row = df.agg(*(f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        self.mean = {c: row[f"m{i}"] for i, c in enumerate(df.columns)}
        self.std = {c: row[f"s{i}"] for i, c in enumerate(df.columns)}
        return self

    def fit_incremental(self, df: DataFrame) -> Transform:
        raise NotImplementedError("Standardize needs all data")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.mean is None:
            raise NotFittedError("fit Standardize first")
        std = self.std or {}
        return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(float(std.get(c) or 1.0)) for c, m in self.mean.items() if c in df.columns})

    def inverse(self) -> Transform:
        if self.mean is None:
            raise NotFittedError("fit Standardize first")
        std = {c: float((self.std or {}).get(c) or 1.0) for c in self.mean}
        return Standardize({c: -m / std[c] for c, m in self.mean.items()}, {c: 1 / s for c, s in std.items()})


class ScaleToRange(Transform):
    """x * m + b, which maps [min, max] to [lower, upper]; a constant column maps to lower."""

    def __init__(self, features: Iterable[str] | None = None, lower_range: float = -1.0, upper_range: float = 1.0) -> None:
        self.features = list(features) if features is not None else None
        self.lower, self.upper = lower_range, upper_range
        self.terms: dict[str, tuple[float, float]] | None = None

    @classmethod
    def from_limits(cls, limits: Mapping[str, tuple[float, float]], lower_range: float = -1.0, upper_range: float = 1.0) -> ScaleToRange:
        """limits: (min, max) of each feature."""
        made = cls(list(limits), lower_range, upper_range)
        made._set(limits)
        return made

    def _set(self, limits: Mapping[str, tuple[float, float]]) -> None:
        self.terms = {}
        for c, (low, high) in limits.items():
            m = (self.upper - self.lower) / (high - low) if low is not None and high != low else 0.0
            self.terms[c] = m, self.lower - (low or 0.0) * m

    def fit(self, df: DataFrame) -> ScaleToRange:
        names = self.features if self.features is not None else [c for c in df.columns if c not in types.series_columns(df)]
        types.require(df, names)
        row = df.agg(*(f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max)))).first()
        self._set({c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(names)})
        return self

    def fit_incremental(self, df: DataFrame) -> Transform:
        raise NotImplementedError("ScaleToRange needs all data")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.terms is None:
            raise NotFittedError("fit ScaleToRange first")
        return df.withColumns({c: F.col(f"`{c}`") * m + b for c, (m, b) in self.terms.items()})

    def inverse(self) -> Transform:
        if self.terms is None:
            raise NotFittedError("fit ScaleToRange first")
        back = ScaleToRange(list(self.terms))
        back.terms = {c: (1 / m, -b / m) for c, (m, b) in self.terms.items() if m}
        return back


class OneHot(Transform):
    """Flags feature_value of the categories, in place of the feature."""

    def __init__(self, categories: Mapping[str, Iterable], check_for_missing_categories: bool = False) -> None:
        self.categories = {c: list(v) for c, v in categories.items()}
        self.check = check_for_missing_categories

    @classmethod
    def from_dataframe(cls, df: DataFrame, features: Iterable[str], check_for_missing_categories: bool = False) -> OneHot:
        """Categories in sorted order; one job for all features."""
        names = list(features)
        types.require(df, names)
        row = df.agg(*(F.array_sort(F.collect_set(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(names))).first()
        return cls({c: row[f"c{i}"] for i, c in enumerate(names)}, check_for_missing_categories)

    def _flag(self, c: str, value) -> Column:
        return F.col(f"`{c}`") == F.lit(value)

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.categories or not all(self.categories.values()):
            raise NoCategoriesError("there are no categories")
        types.require(df, self.categories)
        if self.check:
            unknown = reduce(lambda a, b: a | b, (~F.coalesce(F.col(f"`{c}`").isin(v), F.lit(False)) for c, v in self.categories.items()))
            if not df.where(unknown).isEmpty():
                raise NoMatchingCategoryError("a row has a value outside the categories")
        out = []
        for c in df.columns:
            out += [self._flag(c, v).cast("long").alias(f"{c}_{v}") for v in self.categories[c]] if c in self.categories else [F.col(f"`{c}`")]
        return df.select(*out)


class OneCold(OneHot):
    """The complement of OneHot's flags."""

    def _flag(self, c: str, value) -> Column:
        return F.col(f"`{c}`") != F.lit(value)


class Cluster(Transform):
    """k-means labels beside the other columns; fitted by pyspark.ml, or with any estimator of it."""

    def __init__(self, clusters: int = 2, cluster_feature_name: str = "cluster_label", features: Iterable[str] | None = None, seed: int = 1, estimator=None) -> None:
        self.clusters, self.name, self.seed, self.estimator = clusters, cluster_feature_name, seed, estimator
        self.features = list(features) if features is not None else None
        self.model = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.names, outputCol="_features", handleInvalid="keep").transform(df)

    def fit(self, df: DataFrame) -> Cluster:
        from pyspark.ml.clustering import KMeans

        self.names = self.features or df.columns
        estimator = self.estimator or KMeans(k=self.clusters, seed=self.seed)
        self.model = estimator.setFeaturesCol("_features").setPredictionCol(self.name).fit(self._vectors(df))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFittedError("fit Cluster first")
        return self.model.transform(self._vectors(df)).drop("_features")
