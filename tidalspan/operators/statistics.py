"""Aggregating analyses: divergence of histograms, comparison of traces, point clouds."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-10


def kl_divergence(df: DataFrame, target: str, bins: Mapping[str, float], top_n: int = -1) -> DataFrame:
    """(feature, divergence) between the histograms of rows with a true and a false target, bins of a
    fixed width from the least value; EPSILON smooths empty bins. Highest first; top_n < 0: all."""
    names = list(bins)
    long = df.select(F.col(target).cast("boolean").alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v"), F.lit(float(bins[c])).alias("w")) for c in names))).alias("x")).select("_y", "x.*").where(F.col("v").isNotNull() & F.col("_y").isNotNull())
    least = long.groupBy("feature").agg(F.min("v").alias("low"))  # a row a feature
    counts = (
        long.join(F.broadcast(least), "feature").withColumn("bin", F.floor((F.col("v") - F.col("low")) / F.col("w")))
        .groupBy("feature", "bin").agg(F.sum(F.col("_y").cast("long")).alias("p"), F.sum((~F.col("_y")).cast("long")).alias("q"))
    )
    totals = counts.groupBy("feature").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    share = lambda n, all_: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(all_).cast("double")), F.lit(0.0)) + EPSILON
    each = counts.join(F.broadcast(totals), "feature").select("feature", (share("p", "np") * F.log(share("p", "np") / share("q", "nq"))).alias("d"))
    out = each.groupBy("feature").agg(F.sum("d").alias("divergence")).orderBy(F.desc("divergence"), "feature")
    return out.limit(top_n) if top_n >= 0 else out


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for every pair of labels that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def compare_traces(a: DataFrame, b: DataFrame, keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """(state, mae, rmse, max_error) of two traces with equal keys."""
    right = b.select(*keys, *(F.col(s).alias(f"_{s}") for s in states))
    errors = a.select(*keys, *states).join(right, list(keys)).select(F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.abs(F.col(s) - F.col(f"_{s}")).alias("e")) for s in states))).alias("x")).select("x.*")
    return errors.groupBy("state").agg(F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.max("e").alias("max_error"))


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around points: the circle of two or three of them."""
    pts = np.unique(points, axis=0)
    if len(pts) == 0:
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(0)
    pts = pts[rng.permutation(len(pts))]
    centre, radius = pts[0], 0.0

    def outside(upto: int) -> int:
        d = np.sqrt(((pts[:upto] - centre) ** 2).sum(axis=1))
        far = np.flatnonzero(d > radius * (1 + 1e-12) + 1e-12)
        return int(far[0]) if len(far) else -1

    while (i := outside(len(pts))) >= 0:
        centre, radius = pts[i], 0.0
        while (j := outside(i)) >= 0:
            centre, radius = (pts[i] + pts[j]) / 2, float(np.hypot(*(pts[i] - pts[j]))) / 2
            while (k := outside(j)) >= 0:
                a, b, c = pts[i], pts[j], pts[k]
                m = 2 * np.array([b - a, c - a])
                if abs(np.linalg.det(m)) < 1e-15:
                    break
                centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
                radius = float(np.hypot(*(a - centre)))
            if outside(j) >= 0:
                break
    return float(centre[0]), float(centre[1]), radius


def density_clusters(points: np.ndarray, eps: float = 0.3, min_samples: int = 5) -> np.ndarray:
    """Density-based labels from 0; -1 for noise. Cells of size eps bound the neighbour search."""
    n = len(points)
    labels = np.full(n, -1)
    if not n:
        return labels
    cells: dict[tuple[int, int], list[int]] = {}
    for k, cell in enumerate(map(tuple, np.floor(points / eps).astype(int))):
        cells.setdefault(cell, []).append(k)

    def near(k: int) -> np.ndarray:
        x, y = np.floor(points[k] / eps).astype(int)
        some = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((x + dx, y + dy), ())])
        return some[((points[some] - points[k]) ** 2).sum(axis=1) <= eps * eps]

    around = [near(k) for k in range(n)]
    core = np.array([len(a) >= min_samples for a in around])
    label = 0
    for k in range(n):
        if labels[k] >= 0 or not core[k]:
            continue
        stack = [k]
        labels[k] = label
        while stack:
            for j in around[stack.pop()].tolist():
                if labels[j] < 0:
                    labels[j] = label
                    if core[j]:
                        stack.append(j)
        label += 1
    return labels


CLOUD = ("cog_max", "cog_mean", "cog_median", "cog_min", "cog_std", "cog_mad", "circle_radius", "circle_mean", "circle_std", "clusters", "main_var_x", "main_var_y")


def _cloud(points: np.ndarray) -> list[float | None]:
    if not len(points):
        return [None] * len(CLOUD)
    d = np.sqrt(((points - points.mean(axis=0)) ** 2).sum(axis=1))
    x, y, radius = enclosing_circle(points)
    c = np.sqrt(((points - [x, y]) ** 2).sum(axis=1))
    labels = density_clusters(points)
    found = labels[labels >= 0]
    main = points[labels == np.bincount(found).argmax()] if len(found) else np.zeros((0, 2))
    return [
        float(d.max()), float(d.mean()), float(np.median(d)), float(d.min()), float(d.std()), float(np.median(np.abs(d - np.median(d)))),
        radius, float(c.mean()), float(c.std()), float(len(set(found.tolist()))),
        float(main[:, 0].var()) if len(main) else None, float(main[:, 1].var()) if len(main) else None,
    ]


def particle_cloud_statistics(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """keep, then the statistics CLOUD of each row's cloud: array<struct<x, y>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_cloud(np.array([[p["x"], p["y"]] for p in cell or ()], float).reshape(-1, 2)) for cell in batch.column(len(keep)).to_pylist()]
            made = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(CLOUD))]
            yield pa.record_batch([*(batch.column(k) for k in range(len(keep))), *made], names=[*keep, *CLOUD])

    schema = df.select(*keep).schema
    for c in CLOUD:
        schema = schema.add(c, "double")
    return df.select(*keep, column).mapInArrow(run, schema)
