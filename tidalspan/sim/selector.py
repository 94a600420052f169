"""Looking into, and judging, the tree that selects modes."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidalspan.operators.statistics import confusion_matrix
from tidalspan.streaming.learning import select_modes


def nodes(text: str, features: Sequence[str]) -> list[dict]:
    """The nodes of a tree's debug string: depth, condition (null for a leaf) and prediction."""
    out = []
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip())
        if m := re.search(r"If \(feature (\d+) (<=|>|in|not in) (.+)\)", line):
            out.append({"depth": depth, "condition": f"{features[int(m[1])]} {m[2]} {m[3]}", "prediction": None})
        elif m := re.search(r"Predict: (\S+)", line):
            out.append({"depth": depth, "condition": None, "prediction": float(m[1])})
    return out


def as_text(text: str, features: Sequence[str]) -> str:
    """The debug string with the features' names."""
    return re.sub(r"feature (\d+)", lambda m: features[int(m[1])], text)


def as_dot(text: str, features: Sequence[str]) -> str:
    """The tree as a graph description."""
    lines, stack, number = ["digraph tree {"], [], 0
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip())
        split, leaf = re.search(r"If \(feature (\d+) (.+)\)", line), re.search(r"Predict: (\S+)", line)
        if not split and not leaf:
            continue
        while stack and stack[-1][0] >= depth:
            stack.pop()
        label = f"{features[int(split[1])]} {split[2]}" if split else leaf[1]
        lines.append(f'  n{number} [label="{label}"];')
        if stack:
            lines.append(f"  n{stack[-1][1]} -> n{number};")
        if split:
            stack.append((depth, number))
        number += 1
    return "\n".join([*lines, "}"])


def tree_function(model) -> Callable[[Sequence[float]], float]:
    """A fitted spark.ml tree as a plain function of a row's features."""

    def parse(lines: list[str]) -> tuple | float:
        head = lines[0].strip()
        if m := re.match(r"Predict: (\S+)", head):
            return float(m[1])
        feature, relation, value = re.match(r"If \(feature (\d+) (<=|in) (.+)\)", head).groups()
        depth = len(lines[0]) - len(lines[0].lstrip())
        other = next(k for k, line in enumerate(lines) if k and len(line) - len(line.lstrip()) == depth and line.strip().startswith("Else"))
        chosen = {float(v) for v in value.strip("{}").split(",")} if relation == "in" else float(value)
        return int(feature), chosen, parse(lines[1:other]), parse(lines[other + 1 :])

    root = parse([line for line in model.toDebugString.splitlines()[1:] if line.strip()])

    def decide(row: Sequence[float]) -> float:
        node = root
        while isinstance(node, tuple):
            feature, chosen, yes, no = node
            node = yes if (row[feature] in chosen if isinstance(chosen, set) else row[feature] <= chosen) else no
        return node

    return decide


def details(selector, df: DataFrame) -> DataFrame:
    """df with selected_mode, the leaf that chose it, and mode_probabilities, of a learnt tree."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=selector.inputs, outputCol="_features").transform(df)
    tree = selector.models[0].copy().setLeafCol("leaf").setPredictionCol("selected_mode").setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return tree.transform(rows).withColumn("mode_probabilities", vector_to_array("_probability")).drop("_features", "_probability", "_raw")


def support(model, df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """(leaf, n): how many rows end in each leaf of a fitted spark.ml tree."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(inputs), outputCol="_features").transform(df)
    return model.copy().setLeafCol("leaf").transform(rows).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


def accuracies(df: DataFrame, key: str, order: str, features: Sequence[str], mode: str, history: int, decide) -> DataFrame:
    """(kind, accuracy) of a selector: as an oracle, which knows the true modes before each row, and
    autoregressively, on the modes it has selected itself. Rows before full history do not count."""
    own = select_modes(df, key, order, features, history, mode, decide)
    w = W.partitionBy(key).orderBy(order)
    told = own.withColumns({f"_m{k}": F.lag(mode, k).over(w) for k in range(1, history + 1)} | {f"_f{k}_{c}": F.lag(c, k).over(w) for k in range(1, history + 1) for c in features} | {"_n": F.row_number().over(w)}).where(F.col("_n") > history)
    names = told.columns

    def oracle(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                samples = [[row[f"_f{k}_{c}"] for c in features] for k in range(history, 0, -1)] + [[row[c] for c in features]]
                out.append(int(decide(samples, [int(row[f"_m{k}"]) for k in range(history, 0, -1)])))
            yield frame.assign(oracle=out)

    both = told.mapInPandas(oracle, T.StructType([*told.schema.fields, T.StructField("oracle", T.LongType())])).select(*names, "oracle")
    pairs = F.array(F.struct(F.lit("oracle").alias("kind"), F.col("oracle").alias("said")), F.struct(F.lit("autoregressive").alias("kind"), F.col("selected_mode").alias("said")))
    return both.select(mode, F.explode(pairs).alias("x")).groupBy("x.kind").agg(F.avg((F.col("x.said") == F.col(mode)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, mode: str, selected: str = "selected_mode") -> DataFrame:
    return confusion_matrix(df, mode, selected)
