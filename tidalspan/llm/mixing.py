"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target is a share of the words to take. Its documents are dealt to blocks by a hash. A
ticket is one use of a block; a source's tickets are ordered by pass, and within a pass permuted
by a hash, and its quota is the number of them, from the first, that reaches the target. The last
of them is cut inside: its documents follow in hash order, and the one at the target gives the
words that are missing.

The exact quotas are divided among the output shards by a tree: a node's quotas are split between
its halves by a multivariate hypergeometric draw, down to one shard a leaf, so that every shard
is a fair sample of the whole mix. The shards then draw disjoint runs of the permuted tickets, as
many as their quotas say; a ticket that no quota reaches is not drawn. What is taken of a document
is what the drawn tickets take, and a shard's documents are ordered by a hash of their own.

The tree runs on the driver over at most CLASSES quotas, whatever the number of sources: beyond
it, sources share a class, whose tickets are permuted together (which splits them among its
sources as a hypergeometric draw would). All else are DataFrame functions: sources are numbered
and weighed in tables, sizes are summed by source and block before anything is shuffled, a hot
source is spread over up to MAX_BLOCKS blocks, and only the block at the target is ordered by
document. The BROADCAST_SOURCES largest sources are joined by broadcast, the others by their
name. All randomness comes from hashes and a seed: reruns agree.

Cases: a null text has size 0 and is taken wholly in each of its passes, which adds no words; a
null source is a source of its own, last in order; a source without words has target 0; equal
rows at the target share the missing words; repeated rows are rows each; an empty table gives no
rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidalspan.llm import ranges, storage, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_DOCS = 128
MAX_BLOCKS = 1 << 16
SHARDS = 16
CLASSES = 4096
SEED = 42
#: So many sources at most are joined by broadcast, the largest.
BROADCAST_SOURCES = 50_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_PASSES) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess reshared by weight.
    What `weighed` does in a table, for a list."""
    out = [0.0] * len(sizes)
    free = [k for k, w in enumerate(weights) if w > 0]
    left = total
    while free:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def split(quotas: Sequence[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """quotas of each shard: halves a node's quotas by multivariate hypergeometric draws."""
    import numpy as np

    leaves: list[list[int]] = [[]] * shards
    stack = [(0, shards, [int(q) for q in quotas])]
    while stack:
        first, end, have = stack.pop()
        if end - first == 1:
            leaves[first] = have
            continue
        middle = (first + end) // 2
        rng = np.random.default_rng([seed, first, end])
        total, parts = sum(have), end - first
        exact = total * (middle - first)
        take = exact // parts + int(rng.random() < (exact % parts) / parts)
        left, rest, missing = [], total, take
        for q in have:  # the draw, one source after another: hypergeometric marginals
            got = int(rng.hypergeometric(q, rest - q, missing)) if q and missing and rest > q else min(q, missing)
            left.append(got)
            rest, missing = rest - q, missing - got
        stack += [(first, middle, left), (middle, end, [q - g for q, g in zip(have, left, strict=True)])]
    return leaves


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A literal table, made by SQL functions alone."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def _block_of(source: Column, doc_id: Column, blocks: Column) -> Column:
    return F.pmod(_hash(F.lit("block"), source, doc_id), blocks).cast("int")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with k: their place by name (code points), null last. Ranges are sorted apart, and
    only their row counts meet."""
    rank = F.monotonically_increasing_id()  # the range's number in the upper bits, the row's in the lower 33
    ordered = storage.stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", rank), "mixing-order")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = ordered.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(offsets), part == F.col("_part")).withColumn("k", row + F.col("_before")).drop("_at", "_part", "_before")


def weighed(sources: DataFrame, weights: Sequence[float], share: float, most: float = MOST_PASSES) -> DataFrame:
    """sources (k, total) with target. Each round shares out what is left among the sources that
    the round before did not fill; only sums come to the driver."""
    given = sources.withColumn("_weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights)).cast("int"))).withColumn("_most", most * F.col("total").cast("double"))
    whole = given.agg(F.sum("total"), F.sum("_weight")).first()
    left = total = share * (whole[0] or 0)
    weight = whole[1] or 0.0
    filled = F.lit(False)
    while weight > 0:
        now = F.lit(left) * F.col("_weight") / F.lit(weight) > F.col("_most")
        sums = given.agg(F.sum(F.when(now, F.col("_most"))), F.sum(F.when(~now, F.col("_weight")))).first()
        if (sums[1] or 0.0) >= weight:
            break
        filled, left, weight = now, total - (sums[0] or 0.0), sums[1] or 0.0
    rest = F.lit(left) * F.col("_weight") / F.lit(weight) if weight > 0 else F.lit(0.0)
    return given.withColumn("target", F.when(filled | (F.col("_weight") <= 0), F.least("_most", F.when(F.col("_weight") > 0, F.col("_most")).otherwise(0.0))).otherwise(rest)).drop("_weight", "_most")


class Plan:
    """What to take: a row a source, and the drawn tickets of each block."""

    def __init__(self, sizes: DataFrame, weights: Sequence[float], share: float, shards: int) -> None:
        sized = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
        blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n") / BLOCK_DOCS)))
        made = weighed(storage.stored(numbered(sized), "mixing-numbered"), weights, share)
        self.sources = storage.stored(made.select("k", "source", "n", F.col("total").alias("source_size"), "target", F.rint("target").cast("long").alias("wanted"), blocks.cast("int").alias("blocks")), "mixing-sources")
        self.count = self.sources.count()
        dealt = self.deal(sizes)
        grouped = dealt.groupBy("k", "block").agg(F.sum("size").alias("size"))
        order = W.partitionBy("k").orderBy(_hash(F.lit("order"), "k", "block"), "block").rowsBetween(W.unboundedPreceding, 0)
        end = F.col("turn") * F.col("source_size") + F.col("_end")
        self.tickets = storage.stored(
            grouped.join(self.sources.select("k", "source_size", "wanted"), "k").withColumn("_end", F.sum("size").over(order))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
            .select("k", "block", "turn", "wanted", (end - F.col("size")).alias("start"), end.alias("end")),
            "mixing-tickets",
        )
        self.drawn = storage.stored(self._drawn(shards).join(self._cuts(dealt), ["k", "block"], "left"), "mixing-drawn")

    def deal(self, docs: DataFrame) -> DataFrame:
        """docs with their source's row and their block; a source's row is found by its name."""
        rows = self.sources.withColumnRenamed("source", "_name").drop("n")
        same = F.col("source").eqNullSafe(F.col("_name"))
        if self.count <= BROADCAST_SOURCES:
            given = docs.join(F.broadcast(rows), same)
        else:  # the largest sources, which may be hot, never meet in one task
            large = storage.stored(self.sources.orderBy(F.desc("n"), "k").limit(BROADCAST_SOURCES).select("k"), "mixing-large")
            many, few = rows.join(F.broadcast(large), "k"), rows.join(F.broadcast(large), "k", "left_anti")
            given = docs.join(F.broadcast(many), same).unionByName(docs.join(F.broadcast(many.select("_name")), same, "left_anti").join(few, same))
        return given.drop("_name").withColumn("block", _block_of(F.col("source"), F.col("doc_id"), F.col("blocks")))

    def _drawn(self, shards: int) -> DataFrame:
        """k, block, tickets: array<struct<turn, shard, is_cut>>, those that the shards' quotas reach."""
        needed = F.col("start") < F.col("wanted")
        group = (F.col("k") % CLASSES).cast("int")
        quotas = {r["g"]: r["q"] for r in self.tickets.where(needed).groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("q")).collect()}  # CLASSES rows at most
        groups = sorted(quotas)
        leaves = split([quotas[g] for g in groups], shards)
        rows = []
        for at, g in enumerate(groups):
            ends, total = [], 0
            for leaf in leaves:
                total += leaf[at]
                ends.append(total)
            rows.append({"g": g, "ends": ends})
        ends = F.broadcast(_table(self.tickets.sparkSession, rows, "g int, ends array<bigint>"))
        place = F.row_number().over(W.partitionBy("g").orderBy(F.when(needed, 0).otherwise(1), _hash(F.lit("ticket"), "k", "block", "turn"), "k", "block", "turn")) - 1
        shard = F.size(F.filter("ends", lambda e: e <= F.col("_place")))
        handed = self.tickets.withColumn("g", group).withColumn("_place", place).join(ends, "g").withColumn("shard", shard).where(F.col("shard") < shards)
        return handed.groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "shard", (F.col("end") > F.col("wanted")).alias("is_cut")))).alias("tickets"))

    def _cuts(self, dealt: DataFrame) -> DataFrame:
        """k, block, cut_key, cut_words of each block that the target cuts: the key of the document at
        the target and its words."""
        cut = self.tickets.where((F.col("start") < F.col("wanted")) & (F.col("end") > F.col("wanted"))).select("k", "block", (F.col("wanted") - F.col("start")).alias("cut"))
        inside = dealt.select("k", "block", "doc_id", "size").join(cut, ["k", "block"])
        # equal keys are one step of the order
        keys = inside.select("k", "block", "cut", _hash(F.lit("inside"), "doc_id").alias("h"), "doc_id", "size").groupBy("k", "block", "cut", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
        order = W.partitionBy("k").orderBy("h", "doc_id", "size")
        return (
            keys.withColumn("end", F.sum(F.col("size") * F.col("times")).over(order.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("start", F.col("end") - F.col("size") * F.col("times"))
            .where((F.col("start") < F.col("cut")) & (F.col("end") >= F.col("cut")))
            .select("k", "block", F.struct("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size").alias("cut_key"), F.floor((F.col("cut") - F.col("start")) / F.col("times")).alias("cut_words"))
        )


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, shards: int = SHARDS) -> tuple[Plan, DataFrame]:
    """The plan for docs (doc_id, text, source) and their sizes."""
    sizes = storage.stored(docs.select("doc_id", "source", words.word_count(F.col("text")).alias("size")), "mixing-sizes")
    return Plan(sizes, weights, share, shards), sizes


def draws(docs: DataFrame, plan: Plan) -> DataFrame:
    """docs (doc_id, source, size and whatever else) with source_size, target and draws:
    array<struct<turn, shard, position, words>>, an entry each time that the mix takes the row."""
    dealt = plan.deal(docs).join(plan.drawn, ["k", "block"], "left")
    key = F.struct(_hash(F.lit("inside"), "doc_id").alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size")
    inside = F.when(key < F.col("cut_key"), F.col("size")).when(key == F.col("cut_key"), F.least("size", "cut_words")).otherwise(F.lit(-1).cast("long"))
    taken = F.transform(
        F.coalesce("tickets", F.array().cast("array<struct<turn:int,shard:int,is_cut:boolean>>")),
        lambda t: F.struct(t["turn"], t["shard"], _hash(F.lit("place"), t["shard"], F.col("doc_id"), t["turn"]).alias("position"), F.when(t["is_cut"], inside).otherwise(F.col("size")).alias("words")),
    )
    return dealt.withColumn("draws", F.filter(taken, lambda t: t["words"] >= 0)).drop("tickets", "cut_key", "cut_words", "k", "block", "blocks", "wanted")


_MADE = ("size", "turn", "shard", "position", "words")


def _mix(docs: DataFrame, weights: Sequence[float], share: float, shards: int) -> DataFrame:
    """_given (the row of docs) and the columns _MADE, a row for each time that a row is taken."""
    made, _ = plan(docs, weights, share, shards)
    sized = docs.select(F.struct(*docs.columns).alias("_given"), "doc_id", "source", words.word_count(F.col("text")).alias("size"))
    return (
        draws(sized, made).select("_given", "doc_id", "size", F.inline("draws").alias("turn", "shard", "position", "words"))
        .repartition(shards, F.get(ranges.longs(ranges.names(shards, shards)), F.col("shard")).cast("int")).sortWithinPartitions("shard", "position", "doc_id", "turn").drop("doc_id")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """The mix itself: columns of docs, then size, turn, shard, position and words (which hide columns
    of these names); a row for each time that a document is taken, in its shard's shuffled order. A
    document at a target has the number of its leading words that are taken in words; others have all."""
    return _mix(docs, weights, share, shards).select(*(F.col("_given")[c].alias(c) for c in docs.columns if c not in _MADE), *_MADE)


def mixed(docs: DataFrame, shards: int) -> DataFrame:
    """docs as the mix takes them, a row each time, in shards; a document at a target is taken
    whole if at least half of its words are wanted, else not."""
    return _mix(docs, WEIGHTS, SHARE, shards).where(2 * F.col("words") >= F.col("size")).select("_given.*")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    made, sizes = plan(docs)
    return draws(sizes, made).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda n, t: n + t["words"]).alias("taken"),
        F.transform("draws", lambda t: t["shard"]).alias("shards"),
    )
