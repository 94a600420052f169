"""Blocks: consecutive ranges of a key, of about equal row counts, in the key's order.

A block is named by a number that grows with its range and that Spark's hash partitioning puts in
a partition of its own (or, with more blocks than partitions, in one of those with the fewest), so
that no task gets several blocks by accident while others stay idle. A key that many rows share
fills several bounds; its rows are dealt to as many blocks by a second key, a hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null key, before all others.
LEAST = -(1 << 63)
#: Bytes of a block, as the optimizer estimates them (compressed, for files).
BLOCK_BYTES = 32 << 20


def order_key(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(LEAST))


def longs(values: list[int]) -> Column:
    """One literal array, whatever its length."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def count_for(df: DataFrame, least: int) -> int:
    """How many blocks to make of df: least, or more if its estimated size asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // BLOCK_BYTES))


def bounds(df: DataFrame, key: str, blocks: int) -> list[int]:
    """Upper bounds of all blocks but the last, as many as asked; a frequent key repeats."""
    if blocks < 2:
        return []
    cuts = [k / blocks for k in range(1, blocks)]
    found = df.agg(F.percentile_approx(order_key(F.col(key)), cuts, max(10_000, 20 * blocks)).alias("b")).first()["b"]
    return sorted(found or [])


def _murmur(values: np.ndarray) -> np.ndarray:
    """Spark's hash of ints, the one that deals rows to partitions."""
    with np.errstate(over="ignore"):
        k = values.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).astype(np.int32)


def names(blocks: int, partitions: int) -> list[int]:
    """Growing ints, of which each run of so many as there are partitions falls into all of them."""
    out: list[int] = []
    used: set[int] = set()
    at = 0
    while len(out) < blocks:
        for value, place in zip(range(at, at + 4096), (_murmur(np.arange(at, at + 4096)) % partitions).tolist(), strict=True):
            if place not in used:
                out.append(value)
                used.add(place)
                if len(used) == partitions:
                    used.clear()
        at += 4096
    return out[:blocks]


def block(key: Column, upper: list[int], tie: Column, partitions: int) -> Column:
    """Name of key's block; looks at about two square roots of the bounds. tie: deals the rows of
    a key that fills several blocks."""
    named = longs(names(len(upper) + 1, partitions))
    if not upper:
        return F.get(named, F.lit(0)).cast("int")
    step = math.isqrt(len(upper) - 1) + 1
    value, low, every = order_key(key), longs(upper[step - 1 :: step]), longs(upper)

    def below(fits) -> Column:
        coarse = F.size(F.filter(low, fits))
        return coarse * step + F.size(F.filter(F.slice(every, coarse * step + 1, F.lit(step)), fits))

    at = below(lambda b: b < value)
    if len(set(upper)) < len(upper):
        shared = below(lambda b: b <= value) - at
        part = F.floor((tie.cast("double") / 2.0**64 + 0.5) * shared).cast("int")
        at = F.when(shared > 1, at + F.greatest(F.lit(0), F.least(part, shared - 1))).otherwise(at)
    return F.get(named, at).cast("int")
