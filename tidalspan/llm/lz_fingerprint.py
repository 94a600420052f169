"""Lempel-Ziv phrase fingerprints: texts that compress well together have like fingerprints.

A text is parsed once from left to right into the shortest phrases not seen before (the
dictionary of LZ78). The phrases are hashed; of the hashes that fall into each of BINS equal
ranges the least is kept (one-permutation minimum hashing), and 16 bits of it stand in the
fingerprint. The share of equal bins estimates the share of phrases that two texts have in
common: 1 for equal texts, about 0 for unrelated ones.

Each text is parsed where it is read. Only the comparison with a neighbour in the order of ids
moves texts: ranges of ids go to blocks, one shuffle of the texts, and a block also gets the
first document of the next. An id that many rows share (a null one, say) fills several blocks. A
task holds two texts and their phrases at a time.

Cases: a null text counts as empty and an empty text has no phrases (all bins empty; two such
texts are alike to 1); a null doc_id sorts first; equal doc_ids are ordered by a hash of the text;
a lone document is its own neighbour; repeated rows are rows each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm import ranges, words

BINS = 128
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def parse(text: str, phrases: set[str], open_: str = "") -> str:
    """Adds the phrases of text to phrases; open_ is what an earlier part left over."""
    add = phrases.add
    w = open_
    for c in text:
        w += c
        if w not in phrases:
            add(w)
            w = ""
    return w


def hashes(phrases: set[str]) -> np.ndarray:
    encoded = (p.encode("utf-8", "surrogatepass") for p in phrases)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, encoded), np.uint64, len(phrases))


def signature(*parts: np.ndarray) -> np.ndarray:
    """uint16 a bin: 0 if it is empty, else 16 bits of its least hash."""
    least = np.full(BINS, _NONE)
    for h in parts:
        np.minimum.at(least, (h >> _SHIFT).astype(np.int64), h)
    bits = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(least == _NONE, 0, np.maximum(bits, 1)).astype(np.uint16)


def as_text(found: np.ndarray) -> str:
    return found.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return float(((a == b) & filled).sum()) / n if n else 1.0


class Parsed:
    """A text whose first part (all but the last half) is parsed apart, to be continued twice."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.half = len(self.text) // 2
        self.head: set[str] = set()
        self.cut = len(self.text) - self.half
        self.left = parse(self.text[: self.cut], self.head)
        self.head_hashes = hashes(self.head)
        self.signature = self._go_on(self.text[self.cut :])

    def _go_on(self, rest: str) -> np.ndarray:
        every = self.head.copy()
        parse(rest, every, self.left)
        return signature(self.head_hashes, hashes(every - self.head))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by as much of other, and that text's signature."""
        rest = other[: self.half]
        if rest == self.text[self.cut :]:
            return self.text, self.signature
        return self.text[: self.cut] + rest, self._go_on(rest)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then fingerprint; no shuffle."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(Parsed(t.as_py()).signature) for t in batch.column(n)]
            yield pa.record_batch([*(batch.column(i) for i in range(n)), pa.array(found, pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, docs.select(*keep).schema.add("fingerprint", "string"))


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows (doc_id, text, _block, _extra) in blocks: a block's own documents in order, then, as
    extra, the first of the next block (of the first one after the last)."""
    upper = ranges.bounds(docs, "doc_id", blocks)
    spread = len(set(upper)) < len(upper)  # else no key is in two blocks, and which of its rows is first does not matter
    tie = F.xxhash64("text") if spread else F.lit(0).cast("long")
    given = docs.select("doc_id", "text", ranges.order_key(F.col("doc_id")).alias("_key"), tie.alias("_tie"), ranges.block(F.col("doc_id"), upper, tie, blocks).alias("_block"))
    rows = given.groupBy("_block").agg(F.min(F.struct("_key", "_tie")).alias("f")).select("_block", "f.*").collect()  # at most a row for each block
    firsts = sorted(tuple(r) for r in rows)
    names, keys, ties = (ranges.longs([f[i] for f in firsts]) for i in range(3))
    before = ranges.longs([firsts[at - 1][0] for at in range(len(firsts))])
    at = F.array_position(names, F.col("_block").cast("long")).cast("int") - 1
    also = F.when((F.get(keys, at) == F.col("_key")) & (F.get(ties, at) == F.col("_tie")), F.get(before, at).cast("int"))
    copies = F.when(also.isNull(), F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("e")))).otherwise(
        F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("e")), F.struct(also.alias("b"), F.lit(1).alias("e")))
    )
    return (
        given.select("doc_id", "text", "_key", F.inline(copies).alias("_to", "_extra"))
        .repartition(blocks, "_to").sortWithinPartitions("_to", "_extra", "_key", F.xxhash64("text"), "text")
        .select("doc_id", "text", F.col("_to").alias("_block"), "_extra")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike its neighbours are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def emit(doc_id: int | None, a: Parsed, b: Parsed) -> None:
            text, found = a.edited(b.text)
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(a.text), digest, as_text(a.signature), as_text(found), likeness(a.signature, found), likeness(a.signature, b.signature)))

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return batch

        last = None  # block, doc_id and parse of the row before, if it waits for its neighbour
        for batch in batches:
            for doc_id, text, block, extra in zip(*(batch.column(i) for i in range(4)), strict=True):
                block, extra = block.as_py(), extra.as_py()
                if extra and (last is None or last[0] != block):
                    continue  # equal first ids: one of them is neighbour enough
                now = Parsed(text.as_py())
                if last is not None and last[0] == block:
                    emit(last[1], last[2], now)
                last = None if extra else (block, doc_id.as_py(), now)
                if len(out) >= 2000:
                    yield flush()
        yield flush()

    return with_next(docs, blocks).mapInArrow(run, SCHEMA)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare_with_next(docs, ranges.count_for(docs, words.partitions(spark)))
