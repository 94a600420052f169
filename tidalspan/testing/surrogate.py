"""A surrogate for test generation: rows resampled from a density, and a tree that grows as they come."""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.sources.frames import with_row_number

#: Rows that a tree takes at a time, rows of a block, and leaves of the trees that blocks ahead start from.
PIECE, BLOCK, LEAVES = 8192, 200_000, 20_000


def silverman(n: int, d: int) -> float:
    """Bandwidth of a Gaussian kernel density over n rows of d columns."""
    return (n * (d + 2) / 4) ** (-1 / (d + 4))


def resampled(df: DataFrame, features: Sequence[str], n: int, order_by: str | list[str], whole: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """n rows drawn from the density of the features: a row of df, chosen with replacement, moved by
    Gaussian noise of Silverman's bandwidth in every column; columns in whole are rounded. Drawn by
    the number that an order gives each row: nothing but a count comes to the driver."""
    known = df.dropna(subset=list(features))
    numbered = with_row_number(known, order_by, "_n").select("_n", *(F.col(f"`{c}`").cast("double").alias(c) for c in features))
    count = known.count()
    if not count:
        raise ValueError("there are no rows to draw from")
    h = silverman(count, len(features))
    draws = df.sparkSession.range(n).select(F.col("id").alias("_draw"), (F.floor(F.rand(seed) * count) + 1).alias("_n"))
    moved = {c: F.col(f"`{c}`") + F.lit(h) * _normal(F.col("_draw"), seed, k) for k, c in enumerate(features)}
    return draws.join(numbered, "_n").select(*((F.round(e) if c in whole else e).alias(c) for c, e in moved.items()))


def _normal(draw, seed: int, k: int):
    """A standard normal number of each draw, the same wherever its row is worked out."""
    uniform = lambda salt: (F.pmod(F.xxhash64(draw, F.lit(seed), F.lit(2 * k + salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))


class _Leaf:
    """Counts, and of each feature and class the number, mean and squared deviations of what came."""

    def __init__(self, features: int) -> None:
        self.seen: dict[float, int] = {}
        self.at_check = 0
        self.moments: dict[float, np.ndarray] = {}
        self.low, self.high = np.full(features, np.inf), np.full(features, -np.inf)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows of x, of the classes y."""
        kinds, first = np.unique(y, return_index=True)
        for kind in kinds[np.argsort(first)].tolist():
            own = x[y == kind]
            self.merge(kind, len(own), own.mean(axis=0), ((own - own.mean(axis=0)) ** 2).sum(axis=0))
        self.low, self.high = np.minimum(self.low, x.min(axis=0)), np.maximum(self.high, x.max(axis=0))

    def merge(self, y: float, n: int, mean: np.ndarray, squares: np.ndarray) -> None:
        """n rows of class y with a mean and squared deviations."""
        before = self.seen.get(y, 0)
        m = self.moments.setdefault(y, np.zeros((2, len(mean))))
        gap = mean - m[0]
        m[0] += gap * (n / (before + n))
        m[1] += squares + gap * gap * (before * n / (before + n))
        self.seen[y] = before + n

    def next_check(self, grace: int, others: Callable[[float | None], int]) -> int:
        """How many rows come before the leaf is checked again. others(y): the number of the first row that
        is not of class y (without y: of the first row's), from 1."""
        second = 1 if len(self.seen) > 1 else others(next(iter(self.seen), None))
        return max(1, grace - (sum(self.seen.values()) - self.at_check), second)

    @property
    def prediction(self) -> float:
        return max(sorted(self.seen), key=self.seen.get, default=0.0)


def _other(y: np.ndarray, known: float | None) -> int:
    """The number of the first row that is not of a class, from 1; one more than there are, without one."""
    differs = y != (y[0] if known is None else known)
    return int(differs.argmax()) + 1 if differs.any() else len(y) + 1


class HoeffdingTree:
    """A classifier that sees each row once: a leaf splits when the gain of its best cut exceeds that of
    the second best feature by more than chance allows (Hoeffding's bound at confidence delta), or
    when both are so near that it does not matter (tie)."""

    def __init__(self, features: int, grace: int = 200, delta: float = 1e-7, tie: float = 0.05, cuts: int = 10, max_depth: int = 20) -> None:
        self.features, self.grace, self.delta, self.tie, self.cuts, self.max_depth = features, grace, delta, tie, cuts, max_depth
        self.root: object = _Leaf(features)

    def learn(self, rows: Iterable[tuple[Sequence[float], float]]) -> HoeffdingTree:
        rows = iter(rows)
        while some := list(itertools.islice(rows, PIECE)):
            self.learn_block(np.array([x for x, _ in some], float).reshape(len(some), -1), np.array([y for _, y in some], float))
        return self

    def learn_block(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Rows in order. Leaves do not know of each other, so each takes its rows at once, from one
        check to the next. Returns whether one has split."""
        todo, grown = [(None, 0, self.root, 0, np.arange(len(y)))], False
        while todo:
            parent, side, node, depth, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, list):
                below = x[rows, node[0]] <= node[1]
                todo += [(node, 2, node[2], depth + 1, rows[below]), (node, 3, node[3], depth + 1, rows[~below])]
                continue
            own_x, own_y, at = x[rows], y[rows], 0
            while at < len(rows):
                left = own_y[at:]
                n = node.next_check(self.grace, lambda known, left=left: _other(left, known)) if depth < self.max_depth else len(left) + 1
                node.add(own_x[at : at + n], left[:n])
                at += n
                if n > len(left):
                    break
                node.at_check = sum(node.seen.values())
                if made := self._halves(node):
                    if parent is None:
                        self.root = made
                    else:
                        parent[side] = made
                    todo.append((parent, side, made, depth, rows[at:]))
                    grown = True
                    break
        return grown

    def _halves(self, node: _Leaf) -> list | None:
        split = self._split(node, node.at_check)
        if not split:
            return None
        made = [*split, _Leaf(self.features), _Leaf(self.features)]
        for y, m in node.moments.items():  # the halves begin with the classes they will see
            for at, share in zip((2, 3), self._shares(m, node.seen[y], *split), strict=True):
                if round(share):
                    made[at].seen[y] = round(share)
                    made[at].moments[y] = m.copy()
        return made

    def leaves(self) -> list[tuple[_Leaf, int]]:
        """All leaves from the left, with their depths."""
        out, todo = [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, list):
                todo += [(node[3], depth + 1), (node[2], depth + 1)]
            else:
                out.append((node, depth))
        return out

    def found(self, x: np.ndarray) -> list[np.ndarray]:
        """The rows of x in each leaf, in the order of leaves."""
        out, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, list):
                below = x[rows, node[0]] <= node[1]
                todo += [(node[3], rows[~below]), (node[2], rows[below])]
            else:
                out.append(rows)
        return out

    @staticmethod
    def _shares(m: np.ndarray, n: int, feature: int, cut: float) -> tuple[float, float]:
        """How many of a class's n rows lie below and above, were they normal."""
        deviation = math.sqrt(m[1][feature] / n) if n else 0.0
        below = 0.5 * (1 + math.erf((cut - m[0][feature]) / (deviation * math.sqrt(2)))) if deviation > 0 else float(m[0][feature] <= cut)
        return n * below, n * (1 - below)

    def _split(self, leaf: _Leaf, n: int) -> tuple[int, float] | None:
        def entropy(counts: np.ndarray) -> np.ndarray:
            """Of each column."""
            share = counts / np.maximum(counts.sum(axis=0), 1e-300)
            return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=0)

        before, best = float(entropy(np.array([list(leaf.seen.values())], float).T)[0]), []
        for f in range(self.features):
            found = (0.0, float(leaf.low[f]))
            if leaf.high[f] > leaf.low[f]:
                cuts = np.linspace(leaf.low[f], leaf.high[f], self.cuts + 2)[1:-1].tolist()
                shares = np.array([[self._shares(m, leaf.seen[y], f, cut) for cut in cuts] for y, m in leaf.moments.items()])
                gains = before - sum(shares[:, :, k].sum(axis=0) / n * entropy(shares[:, :, k]) for k in (0, 1))
                found = max(found, *zip(gains.tolist(), cuts, strict=True))
            best.append((*found, f))
        best.sort(reverse=True)
        second = best[1][0] if len(best) > 1 else 0.0
        bound = math.sqrt(math.log2(max(2, len(leaf.seen))) ** 2 * math.log(1 / self.delta) / (2 * n))
        return (best[0][2], best[0][1]) if best[0][0] > 0 and (best[0][0] - second > bound or bound < self.tie) else None

    def predict(self, x: Sequence[float]) -> float:
        node = self.root
        while isinstance(node, list):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node.prediction

    def predictions(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for (leaf, _), rows in zip(self.leaves(), self.found(x), strict=True):
            out[rows] = leaf.prediction
        return out

    def classes(self) -> list[list[tuple[float, float]]]:
        """The leaves as (above, up to) of each feature."""
        out = []

        def walk(node: object, box: list[tuple[float, float]]) -> None:
            if not isinstance(node, list):
                out.append(box)
                return
            f, cut = node[:2]
            low, high = box[f]
            walk(node[2], [*box[:f], (low, min(high, cut)), *box[f + 1 :]])
            walk(node[3], [*box[:f], (max(low, cut), high), *box[f + 1 :]])

        walk(self.root, [(-math.inf, math.inf)] * self.features)
        return out


def surrogate_tree(df: DataFrame, features: Sequence[str], target: str, order_by: str | list[str], **settings) -> HoeffdingTree:
    """The tree over all rows in an order, grown where the rows are, in blocks of BLOCK of them.

    While leaves do not split, a block's part in each is a sum, so many blocks are looked at together:
    their sums give the leaves at the start of each, from which each block is gone through to see
    whether a leaf splits in it. The first such block is taken alone, and the next ones follow from the
    tree after it. The blocks ahead are doubled as long as there is no split. Only the tree, the sums
    and one flag a block pass through the driver.
    """
    names, width = [*features, target], len(features)
    rows = with_row_number(df.dropna(subset=names), order_by, "_n").select("_n", *(F.col(f"`{c}`").cast("double").alias(f"_c{k}") for k, c in enumerate(names)))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        values = block.sort_values("_n")[[f"_c{k}" for k in range(width + 1)]].to_numpy(np.float64)
        return pd.DataFrame({"block": block["_block"].iloc[:1], "rows": [values.tobytes()]})

    tree = HoeffdingTree(width, **settings)
    packed = rows.withColumn("_block", F.floor((F.col("_n") - 1) / BLOCK).cast("long")).groupBy("_block").applyInPandas(pack, "block long, rows binary").persist()
    blocks = packed.count()

    def each(first: int, last: int, work: Callable[[int, np.ndarray, np.ndarray], object]) -> list:
        """work of the blocks from first on, before last, in order."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k, data in zip(frame["block"].tolist(), frame["rows"], strict=True):
                    values = np.frombuffer(data, np.float64).reshape(-1, width + 1)
                    yield pd.DataFrame({"block": [k], "made": [pickle.dumps(work(k, values[:, :-1], values[:, -1]))]})

        made = packed.where(F.col("block").between(first, last - 1)).mapInPandas(run, "block long, made binary").collect()
        return [pickle.loads(r["made"]) for r in sorted(made)]

    try:
        at, ahead = 0, 1
        while at < blocks:
            end = min(blocks, at + max(1, min(ahead, LEAVES // len(tree.leaves()))))
            if end - at == 1:
                [(tree, grown)] = each(at, end, lambda k, x, y, tree=tree: _grown(tree, x, y))
                at, ahead = end, 1 if grown else 2 * ahead
                continue
            starts = [pickle.dumps(tree)]
            for sums in each(at, end, lambda k, x, y, tree=tree: _sums(tree, x, y)):
                tree = pickle.loads(starts[-1])
                _advance(tree, sums)
                starts.append(pickle.dumps(tree))
            split = each(at, end, lambda k, x, y, starts=starts, at=at: pickle.loads(starts[k - at]).learn_block(x, y))
            here = split.index(True) if True in split else end - at
            tree, at, ahead = pickle.loads(starts[here]), at + here, 1 if True in split else 2 * ahead
    finally:
        packed.unpersist()
    return tree


def _grown(tree: HoeffdingTree, x: np.ndarray, y: np.ndarray) -> tuple[HoeffdingTree, bool]:
    split = tree.learn_block(x, y)
    return tree, split


def _sums(tree: HoeffdingTree, x: np.ndarray, y: np.ndarray) -> dict[int, tuple]:
    """What rows add to each leaf that they come to, and where in it its classes come first."""
    out = {}
    for k, rows in enumerate(tree.found(x)):
        if len(rows):
            part = _Leaf(tree.features)
            part.add(x[rows], y[rows])
            first = {kind: int((y[rows] == kind).argmax()) + 1 for kind in part.seen}
            out[k] = part, first
    return out


def _advance(tree: HoeffdingTree, sums: dict[int, tuple]) -> None:
    """The leaves after rows that split none of them."""
    leaves = tree.leaves()
    for k, (part, first) in sums.items():
        (leaf, depth), n = leaves[k], sum(part.seen.values())
        others = lambda known, first=first, n=n: min((at for y, at in first.items() if (at > 1 if known is None else y != known)), default=n + 1)
        check, before = leaf.next_check(tree.grace, others), sum(leaf.seen.values())
        if depth < tree.max_depth and check <= n:
            leaf.at_check = before + check + (n - check) // tree.grace * tree.grace
        for y, count in part.seen.items():
            leaf.merge(y, count, *part.moments[y])
        leaf.low, leaf.high = np.minimum(leaf.low, part.low), np.maximum(leaf.high, part.high)
