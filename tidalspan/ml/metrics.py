"""Metrics over one frame that holds true and predicted columns side by side.

Each gives aggregate expressions, so any number of them takes one job.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pair = tuple[str, str]


class Metric:
    """pairs: (true column, predicted column)."""

    def name(self) -> str:
        return type(self).__name__

    def expressions(self, pairs: Sequence[Pair]) -> dict[str, Column]:
        """Aggregates by sub-name; one named "" is the whole value."""
        raise NotImplementedError

    def compute(self, df: DataFrame, pairs: Sequence[Pair]) -> float | dict[str, float]:
        return evaluate(df, pairs, [self])[self.name()]


def evaluate(df: DataFrame, pairs: Sequence[Pair], metrics: Iterable[Metric]) -> dict[str, float | dict[str, float]]:
    """All metrics in one aggregation."""
    wanted = {m.name(): m.expressions(pairs) for m in metrics}
    flat = [(m, k, e) for m, parts in wanted.items() for k, e in parts.items()]
    row = df.agg(*(e.alias(f"m{i}") for i, (_, _, e) in enumerate(flat))).first()
    out: dict = {}
    for i, (m, k, _) in enumerate(flat):
        if k:
            out.setdefault(m, {})[k] = row[i]
        else:
            out[m] = row[i]
    return out


def _true(pair: Pair) -> Column:
    return F.col(f"`{pair[0]}`").cast("double")


def _error(pair: Pair) -> Column:
    return _true(pair) - F.col(f"`{pair[1]}`").cast("double")


def _count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition.cast("long"), F.lit(0))).cast("double")


class Accuracy(Metric):
    """Share of rows in which all pairs agree."""

    def expressions(self, pairs):
        same = reduce(lambda a, b: a & b, (F.col(f"`{t}`") == F.col(f"`{p}`") for t, p in pairs))
        return {"": F.avg(same.cast("double"))}


class _Binary(Metric):
    def parts(self, pair: Pair) -> tuple[Column, Column, Column]:
        t, p = F.col(f"`{pair[0]}`") == 1, F.col(f"`{pair[1]}`") == 1
        return _count(t & p), _count(~t & p), _count(t & ~p)


class PrecisionScore(_Binary):
    def expressions(self, pairs):
        tp, fp, _ = self.parts(pairs[0])
        return {"": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))}


class Recall(_Binary):
    def expressions(self, pairs):
        tp, _, fn = self.parts(pairs[0])
        return {"": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))}


class FBetaScore(_Binary):
    def __init__(self, beta: float = 1.0) -> None:
        self.beta = beta

    def expressions(self, pairs):
        tp, fp, fn = self.parts(pairs[0])
        b = self.beta**2
        return {"": F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * fn + fp), F.lit(0.0))}


class MaxError(Metric):
    def __init__(self, feature: str | None = None) -> None:
        self.feature = feature

    def expressions(self, pairs):
        chosen = [p for p in pairs if self.feature in (None, p[0])]
        if len(chosen) != 1:
            raise ValueError("MaxError takes exactly one column")
        return {"": F.max(F.abs(_error(chosen[0])))}


class _Regression(Metric):
    """A value for each pair, or with multioutput="uniform_average" their mean."""

    def __init__(self, multioutput: str = "raw_values") -> None:
        if multioutput not in ("raw_values", "uniform_average"):
            raise ValueError(f"unknown multioutput {multioutput!r}")
        self.multioutput = multioutput

    def one(self, pair: Pair) -> Column:
        raise NotImplementedError

    def expressions(self, pairs):
        if self.multioutput == "raw_values":
            return {p[0]: self.one(p) for p in pairs}
        return {"": reduce(lambda a, b: a + b, map(self.one, pairs)) / len(pairs)}


class MeanAbsoluteError(_Regression):
    def one(self, pair):
        return F.avg(F.abs(_error(pair)))


class MeanSquaredError(_Regression):
    def one(self, pair):
        return F.avg(_error(pair) * _error(pair))


class MeanAbsolutePercentageError(_Regression):
    """Denominators are at least the machine epsilon."""

    def one(self, pair):
        return F.avg(F.abs(_error(pair)) / F.greatest(F.abs(_true(pair)), F.lit(sys.float_info.epsilon)))


class R2Score(_Regression):
    """1 - sum(d^2) / sum((y - mean)^2); 1 or 0 for constant truth."""

    def one(self, pair):
        rest, spread = F.sum(_error(pair) * _error(pair)), F.var_pop(_true(pair)) * F.count(_true(pair))
        return F.when(spread != 0, 1 - F.try_divide(rest, spread)).when(rest == 0, 1.0).otherwise(0.0)


class MeanEuclideanDistance(Metric):
    def expressions(self, pairs):
        return {"": F.avg(F.sqrt(reduce(lambda a, b: a + b, (_error(p) * _error(p) for p in pairs))))}


class ClassificationReport(Metric):
    """Precision, recall, F1 and support of each label, as text."""

    def compute(self, df, pairs):
        t, p = pairs[0]
        rows = df.groupBy(F.col(f"`{t}`").alias("t"), F.col(f"`{p}`").alias("p")).count().collect()  # a row a pair of labels
        labels = sorted({r["t"] for r in rows} | {r["p"] for r in rows}, key=str)
        lines = [f"{'':>12} {'precision':>9} {'recall':>9} {'f1-score':>9} {'support':>9}"]
        right = 0
        for label in labels:
            tp = sum(r["count"] for r in rows if r["t"] == label and r["p"] == label)
            said = sum(r["count"] for r in rows if r["p"] == label)
            there = sum(r["count"] for r in rows if r["t"] == label)
            a, b = tp / said if said else 0.0, tp / there if there else 0.0
            right += tp
            lines.append(f"{label!s:>12} {a:>9.2f} {b:>9.2f} {2 * a * b / (a + b) if a + b else 0.0:>9.2f} {there:>9}")
        total = sum(r["count"] for r in rows)
        lines.append(f"{'accuracy':>12} {'':>9} {'':>9} {right / total if total else 0.0:>9.2f} {total:>9}")
        return "\n" + "\n".join(lines)


class Report:
    """model -> metric -> value, or sub-name -> value."""

    def __init__(self, entries: dict[str, dict]) -> None:
        self.entries = entries

    def rows(self) -> list[tuple[str, str, str | None, float]]:
        out = []
        for model, found in self.entries.items():
            for metric, value in found.items():
                if isinstance(value, dict):
                    out += [(model, metric, sub, v) for sub, v in value.items()]
                else:
                    out.append((model, metric, None, value))
        return out

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(a, b, c, str(v)) for a, b, c, v in self.rows()], "model string, metric string, submetric string, value string")

    def __str__(self) -> str:
        return "\n".join(f"{m} | {k}{f' ({s})' if s else ''} | {v:.4f}" if isinstance(v, float) else f"{m} | {k} | {v}" for m, k, s, v in self.rows())


def threshold_scores(df: DataFrame, label: str, probability: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn) for each threshold, in one pass: rows are counted by how many
    thresholds they reach, which is a handful of groups, and summed up from there."""
    reached = F.size(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(f"`{probability}`") >= t))
    counts = df.groupBy(reached.alias("_r"), (F.col(f"`{label}`") == 1).alias("_y")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("_r", "_y", "n", F.posexplode(F.array(*(F.lit(float(t)) for t in sorted(thresholds)))).alias("_k", "threshold"))
    said = F.col("_r") > F.col("_k")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("threshold").agg(total(said & F.col("_y")).alias("tp"), total(said & ~F.col("_y")).alias("fp"), total(~said & F.col("_y")).alias("fn"), total(~said & ~F.col("_y")).alias("tn"))


def tune_threshold(df: DataFrame, label: str, probability: str, beta: float = 1.0, thresholds: Sequence[float] | None = None) -> tuple[float, float]:
    """The lowest of the thresholds with the best F-beta score, and that score."""
    steps = list(thresholds) if thresholds is not None else [round(0.05 * k, 2) for k in range(1, 20)]
    best = (steps[0], -1.0)
    for r in sorted(threshold_scores(df, label, probability, steps).collect(), key=lambda r: r["threshold"]):
        b = beta**2
        below = (1 + b) * r["tp"] + b * r["fn"] + r["fp"]
        score = (1 + b) * r["tp"] / below if below else 0.0
        if score > best[1]:
            best = (r["threshold"], score)
    return best
