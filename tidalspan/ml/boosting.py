"""Adaptive boosting of decision stumps, one aggregation a round."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalspan.ml.learners import SUFFIX, Learner, Model


class StumpModel(Model):
    """A weighted vote of comparisons, as one expression; the score is a probability."""

    def __init__(self, inputs, outputs, stumps: list[tuple[str, float, int, float]], threshold: float = 0.5) -> None:
        super().__init__(inputs, outputs)
        self.stumps, self.threshold = stumps, threshold  # feature, cut, side, weight

    def vote(self) -> Column:
        return reduce(lambda a, b: a + b, (F.when((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) > cut) == F.lit(side > 0), w).otherwise(-w) for c, cut, side, w in self.stumps), F.lit(0.0))

    def _predict(self, df):
        o = self.outputs[0]
        share = 1 / (1 + F.exp(-2 * self.vote()))
        return df.withColumn(f"{o}_probability", share).withColumn(f"{o}{SUFFIX}", (F.col(f"{o}_probability") >= self.threshold).cast("long"))


class AdaBoost(Learner):
    """Cuts are tried at quantiles of each feature; missing values count as 0."""

    def __init__(self, rounds: int = 20, cuts: int = 16, threshold: float = 0.5) -> None:
        self.rounds, self.cuts, self.threshold = rounds, cuts, threshold

    def learn(self, df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> StumpModel:
        (o,) = outputs
        filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in inputs}
        at = [k / (self.cuts + 1) for k in range(1, self.cuts + 1)]
        row = df.agg(*(F.percentile_approx(v, at).alias(f"q{k}") for k, v in enumerate(filled.values()))).first()
        tests = [(c, cut) for k, c in enumerate(inputs) for cut in sorted(set(row[f"q{k}"] or []))]
        one = F.col(f"`{o}`") == 1
        model = StumpModel(list(inputs), [o], [], self.threshold)
        for _ in range(self.rounds):
            # the weight of a row follows from the votes so far, so no weights are stored
            weight = F.exp(-model.vote() * F.when(one, 1.0).otherwise(-1.0))
            sums = df.agg(F.sum(weight).alias("w"), *(F.sum(F.when((filled[c] > cut) != one, weight).otherwise(0.0)).alias(f"e{k}") for k, (c, cut) in enumerate(tests))).first()
            errors = [(min(e := sums[f"e{k}"] / sums["w"], 1 - e), k, 1 if e <= 0.5 else -1) for k in range(len(tests))]
            if not errors:
                break
            error, k, side = min(errors)
            if error >= 0.5:
                break
            model.stumps.append((*tests[k], side, 0.5 * math.log((1 - error + 1e-10) / (error + 1e-10))))
            if error < 1e-10:
                break
        return model
