"""Blocks of ranges: one a partition, in order, hot keys over several."""

import hashlib

import xxhash
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidalspan.llm import lz_fingerprint, ranges, storage, warc


def tie(text):
    """Spark's hash of a text, signed."""
    found = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
    return found - (1 << 64) if found >> 63 else found


def test_names_have_partitions_of_their_own(spark):
    for blocks, partitions in ((1, 1), (8, 8), (50, 13), (211, 211)):
        names = ranges.names(blocks, partitions)
        assert names == sorted(set(names)) and len(names) == blocks
        rows = spark.createDataFrame([(n,) for n in names], "n int").repartition(partitions, "n").groupBy(F.spark_partition_id()).count().collect()
        sizes = sorted(r["count"] for r in rows)
        assert len(sizes) == min(blocks, partitions) and sizes[-1] - sizes[0] <= 1


def test_a_hot_key_fills_several_blocks(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"t{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    upper = ranges.bounds(df, "doc_id", 12)
    at = df.select("doc_id", "text", ranges.block(F.col("doc_id"), upper, F.xxhash64("text"), 12).alias("b")).collect()
    sizes = {}
    for r in at:
        sizes[r["b"]] = sizes.get(r["b"], 0) + 1
    assert max(sizes.values()) < 2 * 250 and len(sizes) >= 10
    order = [r["b"] for r in sorted(at, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, tie(r["text"])))]
    assert order == sorted(order)


def test_neighbours_of_hot_ids(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k} of {k * 7919}") for k in range(300)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    want = []
    for k, (doc, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(text) // 2
        want.append((doc, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    for blocks in (1, 9):
        got = lz_fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), blocks).collect()
        assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)


def test_pages_of_hot_ids(spark):
    rows = [(None if k % 3 == 0 else k, "u", f"<p>{k % 40}") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = storage.new_folder(spark, "test")
    open(f"{folder.removeprefix('file://')}/.pages-000001-00000.warc.gz.dead.tmp", "wb").close()
    manifest = warc.write(df, folder, 6)
    got = warc.read(manifest, folder, 3).collect()
    first = {}
    for k, _, h in rows:
        if k is not None:
            first.setdefault(h, k)
    want = [(k, h.encode() if first[h] == k else None, first[h] if first[h] != k else None) for k, _, h in rows]
    have = [(r["page_id"], None if r["payload"] is None else bytes(r["payload"]), r["refers_to"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    import os

    assert not [n for n in os.listdir(folder.removeprefix("file://")) if n.endswith(".tmp")]


def test_blocks_grow_with_the_table(spark):
    table = storage.stored(H.docs(spark), "test")
    assert ranges.count_for(table, 5) == 5
    size = ranges.BLOCK_BYTES
    try:
        ranges.BLOCK_BYTES = 1000
        assert ranges.count_for(table, 5) > 5
    finally:
        ranges.BLOCK_BYTES = size
