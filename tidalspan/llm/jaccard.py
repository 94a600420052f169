"""Exact links between texts by the Jaccard similarity of their sets of shingle hashes.

Texts of equal sets are one node, named by a hash of the set. Two sets that are alike to the least
similarity share one of their first hashes, in any order that is the same for all sets, if so many
are taken that the others are too few for it; such a prefix is dealt by hash. The order puts rare
hashes first, by counts of hashes in slots: from a part of the texts, as it bears on the work only.
Hashes that the same sets share are one bucket. Candidates of the buckets are cut into pieces that
no link leaves; within a piece every pair that is not joined yet is decided by its sets, so what
is linked is exactly what reaches the least similarity. Links that are known already need no
search: only hashes that two of their groups share are buckets. Counts of a set's hashes in BINS ranges
bound the overlap of two sets from above, and spare the sets of most pairs that are not alike.

A piece is compared whole, by numpy; above two tiles of work it is cut into tiles by a hash, and
its pairs of tiles go to different tasks. A comparison gives a spanning star for each connected
part, not its pairs. Sets are not stored: they are made again from the texts that a step needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidalspan.llm import storage
from tidalspan.llm.components import components

BINS = 256
#: Sets in a tile of a bucket.
BUCKET_TILE = 1024
#: Bits of the slots that hashes are counted in, and one in how many texts is counted.
SLOT_BITS, COUNTED = 20, 8
#: Hashes of sets in a tile, and in a task of small pieces.
WEIGHT = 1 << 20
#: Bits of the filter for texts that a step needs; beyond so many texts it only spares less.
FILTER_BITS = 23
#: Similarities are compared with this slack; those of different sets differ by more.
SLACK = 1e-6
SEED = 42

Shingles = Callable[[str | None], np.ndarray]


def name_of(found: np.ndarray) -> int:
    """The node of a set: sorted distinct hashes."""
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True)


def _filter(longs: DataFrame) -> np.ndarray:
    """Which slots the longs (one column, hashes) fall into, packed."""
    shift = 64 - FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(1 << FILTER_BITS, np.bool_)
        for batch in batches:
            hit[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(shift)] = True
        yield pa.record_batch([pa.array([np.packbits(hit).tobytes()])], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in longs.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def sets_of(docs: DataFrame, shingles: Shingles, wanted: DataFrame, payload: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(node, size, payload): a row for each node of wanted (node, _h: the hash of one of its
    texts). docs: text, _h."""
    bits = _filter(wanted.select("_h"))
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = (batch.column(0).to_numpy().view(np.uint64) >> shift).astype(np.int64)
            nodes, sizes, made = [], [], []
            for k in np.flatnonzero(bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).tolist():
                found = np.unique(shingles(batch.column(1)[k].as_py()))
                nodes.append(name_of(found))
                sizes.append(len(found))
                made.append(payload(found))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["node", "size", "payload"])

    rows = docs.select("_h", "text").mapInArrow(run, "node long, size long, payload binary")
    return rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def counted(found: np.ndarray) -> np.ndarray:
    """How many hashes of a set are in each of BINS ranges."""
    return np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=BINS).astype(np.uint32)


def reaches(common: np.ndarray, a: int, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes a and b with so many common hashes are alike to least."""
    return common >= least * (a + b - common) - SLACK


def linked(sizes: np.ndarray, side: np.ndarray, least: float, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """root of each set among these, which are in the order of their sizes. alike(i, js): which of
    js the set i links to. side: as in simhash.links."""
    root = np.arange(len(sizes))
    ends = np.searchsorted(sizes, sizes / least + SLACK, side="right")  # larger sets cannot be alike
    across = side.any()
    for i in range(len(sizes)):
        js = np.arange(i + 1, ends[i])
        js = js[root[js] != root[i]]  # joined already: nothing to decide
        if across:
            js = js[side[js] != side[i]]
        if len(js):
            js = js[alike(i, js)]
        if len(js):
            same = np.unique(np.append(root[js], root[i]))
            root[np.isin(root, same)] = same[0]
    return root


def by_counts(payloads: list[bytes], sizes: np.ndarray, least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether two sets may be alike; payloads are counts."""
    counts = np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), BINS)
    return lambda i, js: reaches(np.minimum(counts[i], counts[js]).sum(axis=1, dtype=np.int64), sizes[i], sizes[js], least)


def by_sets(payloads: list[bytes], sizes: np.ndarray, least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether two sets are alike; payloads are the sets."""
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    may = by_counts([counted(s).tobytes() for s in sets], sizes, least)
    places = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(places, np.cumsum(sizes)[:-1])
    held = np.zeros(places.max(initial=0) + 1, np.bool_)

    def alike(i: int, js: np.ndarray) -> np.ndarray:
        fit = may(i, js)
        held[own[i]] = True
        common = np.array([np.count_nonzero(held[own[j]]) for j in js[fit]], np.int64)
        held[own[i]] = False
        fit[fit] = reaches(common, sizes[i], sizes[js[fit]], least)
        return fit

    return alike


def edges(rows: DataFrame, weight: Column, tile: int, least: float, judge: Callable) -> DataFrame:
    """(u, v) of rows (piece, node, size, payload) that judge links: a spanning star for each
    connected part of each comparison. weight: of a row, of which a tile holds so much."""
    weights = storage.stored(rows.groupBy("piece").agg(F.sum(weight).alias("w")), "near-weights")
    parts = max(1, -(-(weights.agg(F.sum("w")).first()[0] or 0) // tile))
    # a part of all weight by two tiles: few, so that rows need not meet them by piece
    large = storage.small(weights.where(F.col("w") > 2 * tile).select("piece", F.ceil(F.col("w") / tile).cast("int").alias("tiles")), "near-large")
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(7)), tiles).cast("int")
    # each tile meets every tile of its piece once; the second of a pair is its side 1
    pairs = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda x: F.struct(F.least("_own", x).alias("i"), F.greatest("_own", x).alias("j"), (F.col("_own") > x).cast("int").alias("side")))
    task = F.when(F.col("_tiles") > 1, F.xxhash64("piece", "i", "j")).otherwise(F.pmod(F.xxhash64("piece"), F.lit(parts)))
    work = (
        rows.join(large, "piece", "left").withColumn("_tiles", tiles).withColumn("_own", own)
        .select("*", F.inline(pairs).alias("i", "j", "side")).withColumn("task", task).select("task", "piece", "i", "j", "side", "node", "size", "payload")
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("piece", "i", "j", "size", "node")])
        piece, i, j, side, node, size = (table.column(c).to_numpy() for c in ("piece", "i", "j", "side", "node", "size"))
        payload = table.column("payload")
        cuts = [0, *(np.flatnonzero((np.diff(piece) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(node)]
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            names = node[a:b]
            root = linked(size[a:b], side[a:b], least, judge(payload.slice(a, b - a).to_pylist(), size[a:b], least))
            hub = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(hub, root, names)
            moved = names != hub[root]
            us.append(names[moved])
            vs.append(hub[root][moved])
        return pa.table([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])

    return work.groupBy("task").applyInArrow(compare, "u long, v long")


def levels_of(docs: DataFrame, shingles: Shingles) -> np.ndarray:
    """How common hashes are, by slot: a power of two. docs: text, _h."""
    shift, pieces = np.uint64(64 - SLOT_BITS), 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            for text in batch.column(0):
                slots = (np.unique(shingles(text.as_py())) >> shift).astype(np.int64)
                np.add.at(counts, slots, 1)
        yield pa.record_batch([pa.array(range(pieces), pa.int32()), pa.array([p.tobytes() for p in np.split(counts, pieces)])], names=["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int32).astype(np.int64) for c in table.column("counts"))
        level = np.floor(np.log2(total + 1)).astype(np.uint8)
        return pa.table([table.column("piece").slice(0, 1), pa.array([level.tobytes()])], names=["piece", "levels"])

    some = docs.where(F.pmod("_h", F.lit(COUNTED)) == 0).select("text")
    tasks = max(32, some.rdd.getNumPartitions() // COUNTED)
    rows = some.coalesce(tasks).mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, levels binary").collect()  # 64 rows, 1 MB
    return np.frombuffer(b"".join(bytes(r["levels"]) for r in sorted(rows, key=lambda r: r["piece"])), np.uint8)


def prefix(found: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The first hashes of a set: another set alike to least has one of them among its own first."""
    most = len(found) - int(np.ceil(least * len(found) - SLACK)) + 1 if len(found) else 0
    return found[np.lexsort((found, levels[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:most]]


def candidates(docs: DataFrame, shingles: Shingles, texts: DataFrame, least: float, known: DataFrame) -> DataFrame:
    """(u, v): nodes whose components hold every pair that is alike to least and not joined by known.
    docs: text, _h; texts: node, _h; known: as components gives it. A hash that one known group
    alone shares is no bucket."""
    levels = levels_of(docs, shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # spares copies; they are dropped below in any case
        for batch in batches:
            keys, nodes, lengths = [np.zeros(0, np.uint64)], [], []
            for text in batch.column(0):
                found = np.unique(shingles(text.as_py()))
                node = name_of(found)
                if node in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(node)
                keys.append(prefix(found, levels, least))
                nodes.append(node)
                lengths.append(len(keys[-1]))
            yield pa.record_batch([np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), np.array(lengths, np.int64))], names=["key", "node"])

    # one shuffle; the others of a key are beside it
    dealt = docs.select("text").mapInArrow(run, "key long, node long").repartition("key").dropDuplicates(["key", "node"])
    order = W.partitionBy("key").orderBy("node")
    shared = dealt.withColumn("_before", F.lag("node").over(order)).withColumn("_after", F.lead("node").over(order))
    shared = storage.stored(shared.where("_before IS NOT NULL OR _after IS NOT NULL").select("key", "node"), "near-shared")
    joined = shared.join(known.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = joined.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = same.where("r != s").groupBy("n", "a", "b", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = storage.stored(shared.join(buckets, "key").select(F.col("key").alias("piece"), "node"), "near-members")
    wanted = texts.join(members.select("node").distinct(), "node").select("node", "_h")
    counts = storage.stored(sets_of(docs, shingles, wanted, lambda s: counted(s).tobytes()), "near-counts")
    return edges(members.join(counts, "node"), F.lit(1), BUCKET_TILE, least, by_counts)


def decided(docs: DataFrame, shingles: Shingles, texts: DataFrame, pieces: DataFrame, least: float) -> DataFrame:
    """(u, v): links within each piece, by the sets. pieces: node, piece; docs: text, _h; texts
    (node, _h): one text of each node."""
    sets = storage.stored(sets_of(docs, shingles, texts.join(pieces, "node").select("node", "_h"), lambda s: s.tobytes()), "near-sets")
    found = storage.stored(edges(sets.join(pieces, "node"), F.col("size"), WEIGHT, least, by_sets), "near-links")
    storage.drop(sets)
    return found


def exact_roots(docs: DataFrame, shingles: Shingles, texts: DataFrame, least: float, known: DataFrame) -> DataFrame:
    """(u, v): every node that is not the least of its component, and the least. docs: text, _h;
    texts (node, _h): one text of each node; known: components of links that are decided already."""
    loose = components(candidates(docs, shingles, texts, least, known))
    pieces = storage.stored(loose.select(F.col("u").alias("node"), F.col("v").alias("piece")).unionAll(loose.select("v", "v").distinct()), "near-pieces")
    return components(decided(docs, shingles, texts, pieces, least).unionAll(known))
