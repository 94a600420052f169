"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each of 64 bits, set if over half of the text's shingle hashes have
it set. Equal fingerprints are one node. Nodes are dealt to buckets by the bits under a mask;
with the masks of `blocks_for`, two fingerprints that differ in at most radius bits meet in one
bucket at least. A bucket is compared whole, in tiles sorted by population count: numpy
exclusive-or and bit counts for each pair of tiles, which is skipped when their population
counts differ by more than the radius. Buckets above two tiles are cut into tiles by population
count (and by a hash, where one count has too many); pairs of tiles whose counts differ by more
than the radius are never made, and the others go to different tasks. A comparison gives a
spanning star for each connected piece, not its pairs, so dense groups stay small. Components follow.

With sketches (one-permutation minimum hashes of the same shingles, a byte each), a pair must
also reach a least estimated Jaccard similarity. That verifies links at larger radii.

Cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words
than a shingle count as one shingle; a null doc_id takes part but never names a component (a
component of nulls alone has a null name); repeated rows are a row each; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidalspan.llm import jaccard, storage, words
from tidalspan.llm.components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
TILE = 1024
SLOTS = 128


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; letters A-Z count as a-z."""
    if not text:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts, at = [], 0
    for w in found:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[size:]] + [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(found) - size + 1)


def simhash(h: np.ndarray) -> int:
    """Fingerprint as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def sketch(h: np.ndarray) -> bytes:
    """SLOTS bytes: of the least hash in each range of hashes; an empty range takes the next one's."""
    if not len(h):
        return bytes(SLOTS)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h >> np.uint64(57)).astype(np.int64), h)
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    after = full[np.searchsorted(full, np.arange(SLOTS)) % len(full)]
    return (least[after] >> np.uint64(8)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, size: int, sketched: bool, keep: tuple[str, ...] = ("doc_id",), named: bool = False) -> DataFrame:
    """The columns keep, then fp and sketch (null unless sketched), and if named the node of the
    text's set of hashes."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sketches, nodes = [], [], []
            for text in batch.column(n):
                h = shingle_hashes(text.as_py(), size)
                fps.append(simhash(h))
                sketches.append(sketch(h) if sketched else None)
                if named:
                    nodes.append(jaccard.name_of(np.unique(h)))
            made = {"fp": pa.array(fps, pa.int64()), "sketch": pa.array(sketches, pa.binary())} | ({"node": pa.array(nodes, pa.int64())} if named else {})
            yield pa.record_batch([*(batch.column(i) for i in range(n)), *made.values()], names=[*keep, *made])

    schema = docs.select(*keep).schema.add("fp", "long").add("sketch", "binary")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema.add("node", "long") if named else schema)


def masks_of(blocks: int, chosen: int, most_bits: int) -> list[int]:
    """Signed masks: every choice of so many of the 64 bits' blocks, at most most_bits bits each."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = []
    for choice in combinations(range(blocks), chosen):
        bits = [b for k in choice for b in range(cuts[k], cuts[k + 1])][:most_bits]
        mask = sum(1 << b for b in bits)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def blocks_for(radius: int, nodes: int, tile: int | None = None) -> list[int]:
    """Masks under which fingerprints within radius agree at least once: with radius + c blocks, c
    of them are free of differences. c grows with the number of nodes, so that buckets hold about
    a tile."""
    need = max(0, math.ceil(math.log2(max(nodes, 1) / (tile or TILE))))
    for chosen in (1, 2, 3):
        if (64 * chosen) // (radius + chosen) >= need or chosen == 3:
            return masks_of(radius + chosen, chosen, need) if need else [0]
    raise AssertionError


def _roots(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> None:
    """Joins the pairs into the forest root (in place), vectorised: least labels until stable."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def links(fp: np.ndarray, sketches: np.ndarray | None, side: np.ndarray, radius: int, least: float, step: int = 512) -> np.ndarray:
    """root of each fingerprint among these. side: 0 or 1; pairs of one side are compared only
    where side is 0 throughout (a tile with itself), else pairs across."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, side = fp[order], side[order]
    sketches = sketches[order] if sketches is not None else None
    counts = np.bitwise_count(fp).astype(np.int64)
    root = np.arange(len(fp))
    across = side.any()
    for a in range(0, len(fp), step):
        for b in range(a, len(fp), step):
            if counts[b] - counts[min(a + step, len(fp)) - 1] > radius:
                break  # population counts only grow from here
            near = np.bitwise_count(fp[a : a + step, None] ^ fp[None, b : b + step]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            fit = i < j
            if across:
                fit &= side[i] != side[j]
            i, j = i[fit], j[fit]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                apart = root[x] != root[y]  # joined already: nothing to verify
                x, y = x[apart], y[apart]
                if sketches is not None and len(x):
                    alike = (sketches[x] == sketches[y]).mean(axis=1) >= least
                    x, y = x[alike], y[alike]
                _roots(x, y, root)
    out = np.empty(len(fp), np.int64)
    out[order] = order[root]
    return out


def edges(nodes: DataFrame, radius: int, masks: list[int], least: float = 0.0, tile: int | None = None) -> DataFrame:
    """(u, v) of nodes (node, fp, sketch) that are near: a spanning star for each connected piece of
    each comparison."""
    tile = tile or TILE
    table = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks))))
    dealt = nodes.select("node", "fp", "sketch", table.alias("t")).select("node", "fp", "sketch", "t.*")
    # bands of population counts of about a tile, for buckets above two tiles
    counted = dealt.groupBy("k", "key", F.bit_count("fp").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    bucket, upto = W.partitionBy("k", "key"), (W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(bucket.orderBy("c").rowsBetween(*upto)), F.lit(0))
    cut = counted.withColumn("_all", F.sum("n").over(bucket)).withColumn("band", F.floor(before / tile)).where(F.col("_all") > 2 * tile)
    banded = cut.groupBy("k", "key", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.sum("n") / (2 * tile)).cast("int").alias("tiles"))
    banded = banded.withColumn("first", F.coalesce(F.sum("tiles").over(bucket.orderBy("band").rowsBetween(*upto)), F.lit(0)).cast("int"))
    large = storage.small(banded.groupBy("k", "key").agg(F.collect_list(F.struct("lo", "hi", "tiles", "first")).alias("bands")), "simhash-bands")
    mine = F.get(F.filter("bands", lambda b: (b["lo"] <= F.bit_count("fp")) & (b["hi"] >= F.bit_count("fp"))), F.lit(0))
    own = F.coalesce(F.col("_mine")["first"] + F.pmod(F.xxhash64("node", F.lit(7)), F.col("_mine")["tiles"]).cast("int"), F.lit(0))
    # each tile meets every tile whose counts are near once; the second of a pair is its side 1
    near = F.filter("bands", lambda b: (b["lo"] - F.col("_mine")["hi"] <= radius) & (F.col("_mine")["lo"] - b["hi"] <= radius))
    others = F.coalesce(F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), b["tiles"] - 1), lambda t: b["first"] + t))), F.array(F.lit(0)))
    pairs = F.transform(others, lambda x: F.struct(F.least("_own", x).alias("i"), F.greatest("_own", x).alias("j"), (F.col("_own") > x).cast("int").alias("side")))
    work = (
        dealt.join(large, ["k", "key"], "left").withColumn("_mine", mine).withColumn("_own", own)
        .select("node", "fp", "sketch", "k", "key", F.inline(pairs).alias("i", "j", "side"))
    )

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        u = v = np.zeros(0, np.int64)
        if len(node) > 1:
            given = table.column("sketch").combine_chunks()
            sketches = None if given.null_count else np.frombuffer(b"".join(given.to_pylist()), np.uint8).reshape(len(node), -1)
            root = links(table.column("fp").to_numpy().view(np.uint64), sketches, table.column("side").to_numpy(), radius, least)
            moved = np.flatnonzero(root != np.arange(len(node)))
            # the piece's least node is the hub, in every comparison alike
            hub = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(hub, root, node)
            pieces = np.union1d(moved, root[moved])
            u, v = node[pieces], hub[root[pieces]]
            u, v = u[u != v], v[u != v]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return work.groupBy("k", "key", "i", "j").applyInArrow(compare, "u long, v long")


def near_groups(prints: DataFrame, radius: int, masks_for=None, least: float = 0.0) -> DataFrame:
    """(node, root, component): root names the node's component, component is its least doc_id.
    prints: doc_id, fp, sketch, node; a stored table. masks_for: number of nodes -> masks, by
    default those of blocks_for."""
    nodes = storage.stored(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("rep")), "simhash-nodes")
    count = nodes.count()
    masks = masks_for(count) if masks_for else blocks_for(radius, count)
    roots = components(edges(nodes, radius, masks, least))
    rooted = nodes.select("node", "rep").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    rooted = storage.stored(rooted.select("node", "rep", F.coalesce("root", "node").alias("root")), "simhash-roots")
    named = storage.stored(rooted.groupBy("root").agg(F.min("rep").alias("component")), "simhash-components")
    return storage.stored(rooted.join(named, "root").select("node", "root", "component"), "simhash-groups")


# What documents are near-duplicates in a pipeline: shingles of five words, similarity of 0.8.
NEAR_SHINGLE, NEAR_LEAST = 5, 0.8
#: Bits in which fingerprints of near-duplicates may differ to meet in the tiles: of those at 0.9 or
#: more, four in five on check_s. 230,000 nodes take 8 masks so, and 45 at 8 bits.
NEAR_RADIUS = 7


def near_shingles(text: str | None) -> np.ndarray:
    return shingle_hashes(text, NEAR_SHINGLE)


def near_links(docs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): nodes that are alike to NEAR_LEAST and whose fingerprints' groups are one: the tiles
    group the fingerprints, the sets decide within each group. docs: text, _h; prints: doc_id, fp,
    sketch, node; texts: node, _h."""
    groups = near_groups(prints, NEAR_RADIUS)
    moved = groups.where(F.col("node") != F.col("root"))
    pieces = storage.stored(moved.select("node", F.col("root").alias("piece")).unionAll(moved.select("root", "root").distinct()), "near-tiled")
    return jaccard.decided(docs, near_shingles, texts, pieces, NEAR_LEAST)


def first_of_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) without near-duplicates: of each group the row with the least
    doc_id stays (a null one first, then the least hash of the text), and of repeated rows one.
    Links come from fingerprints in tiles; those between fingerprints that no tile joined come from
    a prefix filter (see jaccard). The sets decide both."""
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    prints = storage.stored(fingerprints(keyed, NEAR_SHINGLE, False, ("doc_id", "_h"), named=True), "near-prints")
    texts = storage.stored(prints.groupBy("node").agg(F.min("_h").alias("_h")), "near-texts")
    tiled = components(near_links(keyed, prints, texts))
    roots = jaccard.exact_roots(keyed, near_shingles, texts, NEAR_LEAST, tiled)
    rows = prints.join(roots, prints["node"] == roots["u"], "left").select(F.coalesce("v", "node").alias("root"), "doc_id", "_h")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "_h")).alias("f")).select(F.col("f.doc_id").alias("_doc"), F.col("f._h").alias("_hash"))
    first = storage.stored(first, "near-first")
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["_doc"]) & (keyed["_h"] == first["_hash"]), "left_semi")
    turn = F.row_number().over(W.partitionBy("doc_id", "_h").orderBy(F.lit(0)))
    return kept.withColumn("_n", turn).where("_n = 1").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = storage.stored(fingerprints(docs, SHINGLE, False).withColumn("node", F.col("fp")), "simhash-prints")
    groups = near_groups(prints, RADIUS)
    return prints.select("doc_id", "fp", "node").join(groups, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
