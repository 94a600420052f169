"""Tables from files and URIs, and frames put together or cut apart."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidalspan.errors import Finished, InvalidUriSchemeError, UnsupportedFileTypeError
from tidalspan.operators.base import Identity, Transform


def read_csv(spark: SparkSession, path: str, separator: str = ",", schema: str | None = None) -> DataFrame:
    """Header names are stripped. Give a schema for large inputs: inferring reads the file twice."""
    reader = spark.read.option("header", True).option("sep", separator)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One object or an array of objects."""
    return spark.read.option("multiLine", True).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A mapping or a list of mappings; the file is read as one text by Spark and parsed on the driver."""
    import yaml

    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    found = yaml.safe_load(text)
    return spark.createDataFrame([found] if isinstance(found, dict) else found)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet, ".yaml": read_yaml, ".yml": read_yaml}


def path_of_uri(uri: str) -> str:
    """The path of a file URI, which may be relative."""
    parts = urlparse(uri)
    if parts.scheme != "file":
        raise InvalidUriSchemeError(f"only file: URIs can be read, not {uri}")
    return f"{parts.netloc}{parts.path}"


def read_uri(spark: SparkSession, uri: str) -> DataFrame:
    path = path_of_uri(uri)
    kind = PurePosixPath(path).suffix
    if kind not in READERS:
        raise UnsupportedFileTypeError(f"no reader for {kind or 'files without a suffix'}")
    return READERS[kind](spark, path)


def read_directory(spark: SparkSession, glob: str, format_: str = "parquet", **options: str) -> DataFrame:
    """All files that a pattern names, as one frame with the file each row is from."""
    return spark.read.format(format_).options(**options).load(glob).withColumn("file", F.col("_metadata.file_path"))


def build_from_directory(path: str, builder: Callable[[str], object], pattern: str = "*", include_files: bool = True, include_folders: bool = True) -> Iterator[object]:
    """builder's result for each entry of a local folder, in order of names."""
    from pathlib import Path

    for entry in sorted(Path(path).glob(pattern)):
        if (entry.is_file() and include_files) or (entry.is_dir() and include_folders):
            yield builder(str(entry))


class Environment:
    """A frame with the transforms that observing it applies."""

    def __init__(self, df: DataFrame, transform: Transform | None = None) -> None:
        self.df, self.transform = df, transform or Identity()

    def observe(self) -> DataFrame:
        return self.transform.apply(self.df)

    def append_transform(self, transform: Transform) -> Environment:
        return Environment(self.df, self.transform.chain(transform))

    def __or__(self, transform: Transform) -> Environment:
        return self.append_transform(transform)

    def __add__(self, other: Environment) -> Chained:
        return Chained([self, other])

    def chain(self, *others: Environment) -> Chained:
        return Chained([self, *others])

    def join(self, *others: Environment, key: str) -> Environment:
        from tidalspan.operators.joins import side_by_side

        return Environment(side_by_side([e.observe() for e in (self, *others)], key))

    def __len__(self) -> int:
        return self.df.count()

    def to_incremental(self, order_by: str | list[str], batch_size: int = 1, size: int | None = None) -> Batches:
        return Batches(self.observe(), order_by, batch_size, size)


class Incremental:
    """Yields frames until it is finished."""

    def observe(self) -> DataFrame:
        raise NotImplementedError

    def step(self) -> None:
        raise NotImplementedError

    def __iter__(self) -> Iterator[DataFrame]:
        try:
            while True:
                yield self.observe()
                self.step()
        except Finished:
            return


class Chained(Incremental):
    """Whole frames one after another."""

    def __init__(self, environments: Iterable[Environment]) -> None:
        self.environments, self.at = list(environments), 0
        if not self.environments:
            raise ValueError("there is nothing to chain")

    def observe(self) -> DataFrame:
        return self.environments[self.at].observe()

    def step(self) -> None:
        if self.at + 1 >= len(self.environments):
            raise Finished
        self.at += 1

    def chain(self, *others: Environment) -> Chained:
        return Chained([*self.environments, *others])

    __add__ = chain

    def collect(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), (e.observe() for e in self.environments))


#: Rows that are sampled to find the ranges of with_row_number.
SAMPLE = 10_000


def _listed(values: Iterable[int]) -> Column:
    """One literal array of longs, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_row_number(df: DataFrame, order_by: str | list[str], name: str = "_row") -> DataFrame:
    """Numbers from 1 in order, over the whole frame, without one task for all rows.

    Rows that the order does not tell apart are told apart by a hash of all their columns, so that
    reruns agree and a frequent value of the order fills several ranges; only rows that are equal in
    every column are interchangeable. The ranges' bounds are the quantiles of SAMPLE rows, chosen by
    another hash of all columns; rows are numbered within ranges, and the ranges' counts (one number
    each) give the offsets. Bounds are values, not a shuffle's own: evaluating the frame again gives
    the same numbers.
    """
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tied = df.withColumn("_tie", F.xxhash64(*hashable))
    order = [*names, "_tie"]
    key = F.struct(*(F.col(f"`{c}`") for c in order))
    found = tied.select(*order).orderBy(F.xxhash64(F.lit(1), *(f"`{c}`" for c in order))).limit(SAMPLE).orderBy(*order).collect()
    cuts = [found[k * len(found) // parts] for k in range(1, parts)] if len(found) >= parts else []
    kinds = [tied.schema[c].dataType for c in order]
    bounds = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(cut, kinds, order, strict=True))) for cut in dict.fromkeys(cuts)]
    part = F.lit(0)
    if bounds:  # about two square roots of the bounds are looked at
        step = math.isqrt(len(bounds) - 1) + 1
        below = lambda some: F.size(F.filter(some, lambda b: b < key))
        coarse = below(F.array(*bounds[step - 1 :: step])) if len(bounds) >= step else F.lit(0)
        part = coarse * step + below(F.slice(F.array(*bounds), coarse * step + 1, F.lit(step)))
    cut_up = tied.withColumn("_part", part)
    counts = {r["_part"]: r["count"] for r in cut_up.groupBy("_part").count().collect()}
    before = [0, *itertools.accumulate(counts.get(k, 0) for k in range(len(bounds)))]
    offset = F.get(_listed(before), F.col("_part"))
    return cut_up.withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order)) + offset).drop("_part", "_tie")


class Batches(Incremental):
    """Consecutive batches of a frame in an order; batch k has rows k * size + 1 to (k + 1) * size."""

    def __init__(self, df: DataFrame, order_by: str | list[str], batch_size: int = 1, size: int | None = None) -> None:
        if batch_size < 1:
            raise ValueError("a batch has at least one row")
        self.rows = batch_ids(df, order_by, batch_size).persist()
        self.size = self.rows.count() if size is None else size
        self.batch_size, self.at = batch_size, 0

    @property
    def num_steps(self) -> int:
        return -(-self.size // self.batch_size)

    def observe(self) -> DataFrame:
        return self.rows.where(F.col("batch") == self.at).drop("batch")

    def aggregated(self, *aggregates: Column) -> DataFrame:
        """batch and the aggregates of every batch, by one job and not one for each."""
        return self.rows.where(F.col("batch") < self.num_steps).groupBy("batch").agg(*aggregates)

    def step(self) -> None:
        if self.at + 1 >= self.num_steps:
            self.rows.unpersist()
            raise Finished
        self.at += 1


def batch_ids(df: DataFrame, order_by: str | list[str], batch_size: int) -> DataFrame:
    """df with batch: the number of each row's batch."""
    return with_row_number(df, order_by).withColumn("batch", F.floor((F.col("_row") - 1) / batch_size).cast("long")).drop("_row")


class DatasetPrediction(Batches):
    """Batches that take actions: what a model predicts for the batch at hand."""

    def __init__(self, df: DataFrame, order_by: str | list[str], batch_size: int = 1) -> None:
        super().__init__(df, order_by, batch_size)
        self.actions: list[DataFrame] = []

    def act(self, action: DataFrame) -> None:
        self.actions.append(action)


def collect(frames: Iterable[DataFrame], n: int | None = None) -> DataFrame:
    """The first n frames (all without n), one below the other."""
    taken = []
    for k, df in enumerate(frames):
        if n is not None and k >= n:
            break
        taken.append(df)
    return reduce(lambda a, b: a.unionByName(b), taken)


def train_test_split(df: DataFrame, ratio: float, order_by: str | list[str], shuffle: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first int(n * ratio) rows in order, and the rest; with shuffle, in a seeded random order.
    Sizes are exact and reruns agree."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio lies between 0 and 1")
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    keyed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *names)) if shuffle else df
    numbered = with_row_number(keyed, ["_hash", *names] if shuffle else names)
    pivot = int(df.count() * ratio)
    rows = numbered.drop("_hash") if shuffle else numbered
    return rows.where(F.col("_row") <= pivot).drop("_row"), rows.where(F.col("_row") > pivot).drop("_row")


def save_traces(traces: DataFrame, path: str, format_: str = "parquet", metadata: dict | None = None) -> None:
    """A folder for each trace_id, and the metadata as a text file beside them."""
    traces.write.mode("overwrite").partitionBy("trace_id").option("header", True).format(format_).save(f"{path}/traces")
    spark = traces.sparkSession
    spark.createDataFrame([(json.dumps(metadata or {}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class FrameAdapter:
    """Serves a frame row by row in order, and keeps what is sent back.

    Rows are fetched by one job, a partition at a time. Results are kept here up to KEPT rows, then
    they go, together, to files under folder (if one is given).
    """

    KEPT = 10_000

    def __init__(self, source: DataFrame, order_by: str | list[str], inputs: list[str] | None = None, folder: str | None = None) -> None:
        self.source = source.select(*inputs) if inputs else source
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        self.ordered = source.orderBy(*names).select(*self.source.columns)
        self.results, self.over, self.folder, self.spilled, self.rows = [], False, folder, 0, iter(())

    def start(self) -> None:
        self.over, self.rows = False, self.ordered.toLocalIterator(prefetchPartitions=True)

    def get_data(self) -> DataFrame:
        row = None if self.over else next(self.rows, None)
        if row is None:
            self.over = True
            raise Finished
        return self.source.sparkSession.createDataFrame([row], self.source.schema)

    def send_data(self, data: DataFrame) -> None:
        self.results += data.collect()  # the answer to one row
        if self.folder and len(self.results) >= self.KEPT:
            self._spill()

    def _spill(self) -> None:
        self.source.sparkSession.createDataFrame(self.results).write.mode("append").parquet(f"{self.folder}/results")
        self.spilled, self.results = self.spilled + len(self.results), []

    def stop(self, path: str | None = None) -> DataFrame | None:
        spark = self.source.sparkSession
        if self.spilled and self.results:
            self._spill()
        if not self.spilled and not self.results:
            return None
        out = spark.read.parquet(f"{self.folder}/results") if self.spilled else spark.createDataFrame(self.results)
        if path:
            out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return out
