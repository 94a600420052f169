"""Substring dedup with a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Documents are taken in the order of their ids, in blocks
(ranges of ids); a block is one batch of the index. Each block hashes its windows, keeps one
of each, sorts them and sends them to the shards of the index, which are ranges of the hash.
A shard holds immutable sorted runs: it looks a sorted batch up in each run, answers which of the
batch's hashes an earlier batch had, adds the others as a new run, and merges runs of like
size, so that it has a logarithm of the batches' number of them. The answers, one bit a hash,
go back to the blocks, where they say which windows occurred before; repeats inside a block
are found there. Words that such windows cover are removed.

A match needs equal 64-bit hashes and is verified by 32 bits of a hash of the window that is
made of other hashes of its words, 96 bits in all. Frequent windows are no burden: a block sends
each once. The texts are shuffled once (both uses read the same exchange), hashes at some 10 bytes
a word. Blocks and shards grow in number with the table.

With a folder, runs are kept there as tables and later batches are judged against them. A batch
has a name: its result is written first, then its run, then a mark; under a name that is marked,
the stored result is returned and nothing is added, so a batch that failed can be run again. Runs
are merged only when their batches are marked.

Cases: null and empty texts have no words; texts shorter than a window keep all words; a null
doc_id comes first; rows with equal ids are ordered by a hash of the text and may fill several
blocks, and repeated rows lose what the first of them keeps; an empty table gives no rows, and as
a batch adds nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm import ranges, storage, words

WINDOW = 20
#: Runs of a shard that are kept as tables before they are merged into one.
FANOUT = 4

_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = {m: pow(m, -1, 1 << 64) for m in (_P, _Q)}


class WordNumbers(dict):
    """word -> number; and two 64-bit hashes of each, which have no bits in common."""

    def __init__(self) -> None:
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return found

    def hashes(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _polynomial(w: np.ndarray, starts: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of the length words from each start: sum of w[start + j] * base**j, mod 2**64."""
    powers = np.full(len(w), base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers, out=sums[1:])
    inverse = np.full(len(w), _INVERSE[base], np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return (sums[starts + length] - sums[starts]) * inverse[starts]


class Block:
    """The windows of a block of documents, in order."""

    def __init__(self, texts: list[str | None], length: int = WINDOW) -> None:
        numbers = WordNumbers()
        parts = []
        for text in texts:
            found = words.words_of(text)
            parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        self.length = length
        self.sizes = np.array([len(p) for p in parts], np.int64)
        w = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first, second = numbers.hashes().T
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.starts = np.flatnonzero(ends - np.arange(len(w)) >= length)
        if len(self.starts):
            h = _mixed(_polynomial(first[w], self.starts, length, _P))
            c = (_mixed(_polynomial(second[w], self.starts, length, _Q)) >> np.uint64(32)).astype(np.uint32)
        else:
            h, c = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.order, self.fresh = order, fresh
        self.h, self.c = h[fresh], c[fresh]

    def covered(self, seen: np.ndarray) -> np.ndarray:
        """Which words repeated windows cover; seen: for each of h, whether an earlier block has it."""
        repeated = np.empty(len(self.order), bool)
        repeated[self.order] = ~self.fresh | seen[np.cumsum(self.fresh) - 1] if len(self.order) else False
        n = int(self.sizes.sum())
        edges = np.zeros(n + 1, np.int32)
        at = self.starts[repeated]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.length, -1)
        return np.cumsum(edges[:-1]) > 0


def pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted hashes and their checks, byte plane by byte plane: the upper planes compress well."""
    return h.view(np.uint8).reshape(-1, 8).T.tobytes() + c.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    h = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    return h, np.frombuffer(data, np.uint32, n, 8 * n)


class Runs:
    """One shard of the index: sorted immutable runs."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def seen(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for rh, rc in self.runs:
            at = np.searchsorted(rh, h)
            while True:  # equal hashes with other checks stand side by side; the loop all but always runs once
                hit = at < len(rh)
                hit[hit] = rh[at[hit]] == h[hit]
                found[hit] |= rc[at[hit]] == c[hit]
                rest = hit & ~found
                if not rest.any():
                    break
                at = np.where(rest, at + 1, len(rh))
        return found

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        if not len(h):
            return
        self.runs.append((h, c))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            self.runs[-2:] = [merged(self.runs[-2:])]


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of several; the stable sort merges what is sorted already, in linear time."""
    h = np.concatenate([r[0] for r in runs])
    c = np.concatenate([r[1] for r in runs])
    order = np.argsort(h, kind="stable")
    return h[order], c[order]


def _blocked(docs: DataFrame, blocks: int) -> DataFrame:
    upper, tie = ranges.bounds(docs, "doc_id", blocks), F.xxhash64("text")
    return docs.select("doc_id", "text", tie.alias("_tie"), ranges.block(F.col("doc_id"), upper, tie, words.partitions(docs.sparkSession)).alias("_block"))


def _in_order(table: pa.Table) -> tuple[list, list]:
    rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "_tie", "text")), strict=True)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or ""))
    return [r[0] for r in rows], [r[2] for r in rows]


_PIECES = pa.schema([("_block", pa.int32()), ("_shard", pa.int32()), ("data", pa.binary())])
_ANSWERS = pa.schema([("_block", pa.int32()), ("_shard", pa.int32()), ("data", pa.binary()), ("is_run", pa.bool_())])
_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]


def dedupe(docs: DataFrame, blocks: int, length: int = WINDOW, folder: str | None = None, with_text: bool = False, batch: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text. docs: doc_id, text. With a
    folder, documents of earlier calls count as earlier, and this call's windows are added; a call
    under the name of an earlier one (batch: letters and digits) returns that one's result."""
    spark = docs.sparkSession
    bits = max(1, (blocks - 1).bit_length())
    if folder:
        batch = batch or uuid.uuid4().hex
        if not batch.isalnum():
            raise ValueError("a batch is named by letters and digits")
        if _exists(spark, f"{folder}/{_MARK}-{batch}") or any(n.endswith(f"-{batch}") for n in _tables(spark, folder)):
            return spark.read.parquet(f"{folder}/{_RESULTS}-{batch}")
        bits = _index_bits(spark, folder, bits)
    edges = [np.uint64(k << (64 - bits)) for k in range(1 << bits)]

    def fingerprint(table: pa.Table) -> pa.Table:
        found = Block(_in_order(table)[1], length)
        cuts = [*np.searchsorted(found.h, edges).tolist(), len(found.h)]
        rows = [(k, pack(found.h[a:b], found.c[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        own = table.column("_block")[0].as_py()
        return pa.table([pa.array([own] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PIECES)

    def ask(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: r[0])
        index, new, out = Runs(), Runs(), []
        for own, shard, data in rows:
            h, c = unpack(data)
            if own < 0:  # a run of earlier calls
                index.add(h, c)
                continue
            seen = index.seen(h, c)
            out.append((own, shard, np.packbits(seen).tobytes(), False))
            index.add(h[~seen], c[~seen])
            if folder:
                new.add(h[~seen], c[~seen])
        if new.runs:
            out.append((-1, rows[0][1], pack(*merged(new.runs)), True))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, _ANSWERS.types, strict=True)], schema=_ANSWERS)

    def remove(own: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _in_order(own)
        found = Block(texts, length)
        cuts = [*np.searchsorted(found.h, edges).tolist(), len(found.h)]
        seen = np.zeros(len(found.h), bool)
        for shard, data in zip(answers.column("_shard").to_pylist(), answers.column("data").to_pylist(), strict=True):
            a, b = cuts[shard], cuts[shard + 1]
            seen[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a)
        gone = found.covered(seen)
        out: list[list] = [[], [], [], [], []]
        at = 0
        for doc_id, text, size in zip(ids, texts, found.sizes.tolist(), strict=True):
            mask = gone[at : at + size]
            at += size
            every = words.words_of(text)
            kept = b" ".join([w for w, g in zip(every, mask.tolist(), strict=True) if not g] if mask.any() else every)
            for column, value in zip(out, (doc_id, size, int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None), strict=True):
                column.append(value)
        fields = [*_RESULT, *[("kept_text", pa.string())] * with_text]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=False)], schema=pa.schema(fields))

    blocked = _blocked(docs, blocks)
    pieces = blocked.groupBy("_block").applyInArrow(fingerprint, "_block int, _shard int, data binary")
    if folder:
        pieces = pieces.unionByName(_runs(spark, folder))
    # a shard to each partition, like the blocks
    place = F.get(ranges.longs(ranges.names(1 << bits, words.partitions(spark))), F.col("_shard")).cast("int")
    answers = pieces.withColumn("_place", place).groupBy("_place").applyInArrow(ask, "_block int, _shard int, data binary, is_run boolean")
    new = None
    if folder:
        answers = storage.stored(answers, "substring-answers")
        new, answers = answers.where("is_run"), answers.where("not is_run")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    result = blocked.groupBy("_block").cogroup(answers.select("_block", "_shard", "data").groupBy("_block")).applyInArrow(remove, schema)
    if folder:
        path = f"{folder}/{_RESULTS}-{batch}"
        result.write.mode("overwrite").parquet(path)
        _keep_runs(new, folder, bits, batch)
        result = spark.read.schema(schema).parquet(path)
    return result


_RESULTS, _MARK = "result", "done"


def _exists(spark, path: str) -> bool:
    """Whether a table is there, and whole."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _tables(spark, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath().getName()) for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(n for n in found if n.startswith("run-") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def _index_bits(spark, folder: str, bits: int) -> int:
    """The shards of an index stay what they were when it began: its tables' names hold their number."""
    names = _tables(spark, folder)
    return int(names[0].split("-")[2]) if names else bits


_RUN_COLUMNS = "_shard int, data binary"


def _runs(spark, folder: str) -> DataFrame:
    """Runs of earlier calls, as pieces of a block before all others."""
    names = _tables(spark, folder)
    rows = spark.read.schema(_RUN_COLUMNS).parquet(*(f"{folder}/{n}" for n in names)) if names else spark.createDataFrame([], _RUN_COLUMNS)
    return rows.select(F.lit(-1).cast("int").alias("_block"), "_shard", "data")


def _keep_runs(new: DataFrame, folder: str, bits: int, batch: str) -> None:
    """Adds a run to each shard, of which there are 2**bits; with FANOUT tables there, they are merged into one."""
    spark = new.sparkSession
    names = _tables(spark, folder)
    number = int(names[-1].split("-")[1]) + 1 if names else 0
    names.append(f"run-{number:08d}-{bits}-{batch}")
    new.select("_shard", "data").write.mode("overwrite").parquet(f"{folder}/{names[-1]}")  # from here on the batch is in the index
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/{_MARK}-{batch}")
    if len(names) >= FANOUT:

        def compact(table: pa.Table) -> pa.Table:
            h, c = merged([unpack(d) for d in table.column("data").to_pylist()])
            return pa.table([pa.array([table.column("_shard")[0].as_py()], pa.int32()), pa.array([pack(h, c)], pa.binary())], names=["_shard", "data"])

        for n in names:  # runs whose batch was not marked yet, by a crash just before
            if n.count("-") == 3:
                spark.range(1).write.mode("overwrite").parquet(f"{folder}/{_MARK}-{n.split('-')[3]}")
        every = spark.read.schema(_RUN_COLUMNS).parquet(*(f"{folder}/{n}" for n in names))
        every.groupBy("_shard").applyInArrow(compact, _RUN_COLUMNS).write.mode("overwrite").parquet(f"{folder}/run-{number + 1:08d}-{bits}")
        for n in names:  # a crash before this leaves hashes in two runs, which changes no answer
            storage.delete(spark, f"{folder}/{n}")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # two blocks a partition: a task holds one at a time, and hashing deals them more evenly
    return dedupe(docs, ranges.count_for(docs, 2 * words.partitions(spark)))
