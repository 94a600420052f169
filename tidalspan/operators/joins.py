"""Joins on time: as-of, alignment, nearest-earlier lookup, and side-by-side by row key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], direction: str = "forward") -> DataFrame:
    """left with the values of the right row that is next (forward, inclusive) or last before it
    (backward, inclusive) in time, within equal keys. One union and one window: both sides are
    shuffled once by key, whatever the number of matches. Of right rows at one time, forward takes
    the first and backward the last by their values."""
    keys = [*by]
    carried = [c for c in left.columns]
    packed = F.struct(*(F.col(v) for v in values))
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*carried).alias("_row"), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*carried).alias("r")).schema["r"].dataType).alias("_row"), packed.alias("_v"))
    part = [f"_k{i}" for i in range(len(keys))]
    if direction == "forward":
        order = [F.col("_t").asc(), F.col("_side").desc(), F.col("_v").asc()]
        found = F.first("_v", ignorenulls=True).over(W.partitionBy(*part).orderBy(*order).rowsBetween(0, W.unboundedFollowing))
    elif direction == "backward":
        order = [F.col("_t").asc(), F.col("_side").asc(), F.col("_v").asc()]
        found = F.last("_v", ignorenulls=True).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown direction {direction!r}")
    rows = a.unionByName(b).withColumn("_found", found).where(F.col("_side") == 1)
    return rows.select("_row.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def align(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer alignment on keys: a row for each key of any frame, other columns side by side.
    One union and one aggregation in place of a chain of outer joins."""
    columns = [[c for c in f.columns if c not in keys] for f in frames]
    every = [c for own in columns for c in own]
    if len(set(every)) != len(every):
        raise ValueError("the frames share columns that are no keys")
    parts = [f.select(*keys, *own) for f, own in zip(frames, columns, strict=True)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in every))


def side_by_side(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames joined on their row key; rows that one lacks have nulls there."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def only_times_of(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df whose keys occur in reference."""
    return df.join(reference.select(*keys).distinct(), list(keys), "left_semi")


def forward_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Nulls replaced by the last value before them."""
    w = W.partitionBy(*by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def segments(df: DataFrame, flag: str, by: Sequence[str], order_by: str) -> DataFrame:
    """Contiguous runs of rows with a true flag: by, segment (from 0), start, end, n."""
    w = W.partitionBy(*by).orderBy(order_by)
    numbered = df.withColumn("_n", F.row_number().over(w))
    runs = numbered.where(F.col(flag)).withColumn("_g", F.col("_n") - F.row_number().over(w))
    found = runs.groupBy(*by, "_g").agg(F.min(order_by).alias("start"), F.max(order_by).alias("end"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("segment", F.row_number().over(W.partitionBy(*by).orderBy("start")) - 1).drop("_g")
