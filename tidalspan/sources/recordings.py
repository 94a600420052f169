"""Recorded topics: a Spark data source over any reader of message files.

No reader of a bag format is at hand here, so the source takes one: a function from a path to
(topic, time, message) triples, messages as nested mappings. Each file is a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[str], Iterable[tuple[str, float, Mapping[str, Any]]]]


def dotted(message: Mapping[str, Any], path: str) -> Any:
    """The value at a path like pose.position.x."""
    return reduce(lambda m, k: m[k], path.split("."), message)


def read_messages(spark: SparkSession, paths: Sequence[str], topics: Mapping[str, Sequence[str]], reader: Reader) -> DataFrame:
    """file, topic, time and values (by path, as doubles) of the named topics' messages."""
    wanted = {t: list(p) for t, p in topics.items()}

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for file in frame["file"]:
                rows = [(file, topic, float(time), {p: float(dotted(m, p)) for p in wanted[topic]}) for topic, time, m in reader(file) if topic in wanted]
                yield pd.DataFrame(rows, columns=["file", "topic", "time", "values"])

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "file string, topic string, time double, values map<string,double>")


def load_recordings(spark: SparkSession, paths: Sequence[str], topics: Mapping[str, Sequence[str]], reader: Reader, cache_path: str | None = None) -> DataFrame:
    """One row a file, one series column a topic, its value a struct of the paths (dots kept)."""
    if cache_path:
        try:
            return spark.read.parquet(cache_path)
        except Exception as e:  # no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    messages = read_messages(spark, paths, topics, reader)
    made = []
    for topic, fields in topics.items():
        value = F.struct(*(F.col("values")[p].alias(p) for p in fields))
        made.append(F.array_sort(F.collect_list(F.when(F.col("topic") == topic, F.struct(F.col("time"), value.alias("value"))))).alias(topic))
    out = messages.groupBy("file").agg(*made)
    if cache_path:
        out.write.mode("overwrite").parquet(cache_path)
        return spark.read.parquet(cache_path)
    return out
