"""Harmonic packing of tokenised documents into fixed-length sequences.

The capacity C is split into reciprocal classes: class k holds the documents of more than C/(k+1)
and at most C/k ids, and a bin of class k takes exactly k of them, whole. What such a bin leaves
free is filled from a stock: the remainders of documents longer than C (which give whole
sequences first) and the documents shorter than those of class CLASSES. The largest that fits
goes in whole; only when none fits is one cut, a remainder before a whole document. A bin waits
for stock, and the stock for bins, up to WAITING bins and STOCK capacities; then a bin is filled
as it is, or one of the shortest documents' bins is dissolved into the stock. So nothing is padded,
nearly every document that fits a sequence stays whole, and each bin cuts about one at most.

Every Spark task fills its own bins: there is no shuffle and no state beyond these bounds. When a
task ends, its last, short sequence is cut at powers of two, which need no padding either.

Ids are those that the `tokenizers` library gives. Where its file describes plain byte-level
pairs, the vocabulary and merges are taken from the file into `tiktoken`, which gives the same ids
in about a sixth of the time (tests hold both against each other); any other file, and any text
that it fails on, is left to the library itself.

Cases: a null text counts as empty (it holds the end id alone); a null doc_id stays null;
repeated rows are packed each; special strings in a text become their ids, as the library has it;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CAPACITY = 2048
END_ID = 1
CLASSES = 16
WAITING = 64
STOCK = 16
#: Sequence ids of a task start at its partition's number times this.
TASK_SPAN = 1 << 36

# Fixed value: how a byte-level vocabulary cuts a text into pieces, with possessive repeats.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_LONG = 1 << 20
#: Ids in a batch of output.
_BATCH = 1 << 19

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
    others, in order, for what follows them."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_of(described: dict) -> dict[bytes, int] | None:
    """bytes -> id out of a tokenizer's description; None unless it is plain byte-level pairs, merged
    in the order of their ids."""
    model, cut = described["model"], described.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or described.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    letters, vocabulary = byte_letters(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    if ids != sorted(ids) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    added = {t["content"] for t in described.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}


class Encoder:
    """text -> ids of a tokenizer file."""

    def __init__(self, path: str, quick: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.between = regex.compile(r"(?<=\S) (?=\S)")  # a piece always starts here
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ranks = ranks_of(json.loads(self.whole.to_str())) if quick else None
        self.quick = None
        if ranks:
            import tiktoken

            self.quick = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):  # very long texts a stretch at a time
            cut = self.between.search(text, at + _LONG) if len(text) - at > _LONG else None
            end = cut.start() if cut else len(text)
            part = text[at:end]
            try:
                yield np.array(self.quick.encode_ordinary(part), np.int32)
            except BaseException as e:  # its native code gives up on some patterns of very long texts
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
                yield self._slow(part)
            at = end

    def ids(self, text: str, end_id: int) -> np.ndarray:
        """Ids of the text, then end_id."""
        if not self.quick:
            found = [self._slow(text)]
        elif self.parts and any(s in text for s in self.special):
            found = [np.array([self.special[p]], np.int32) if p in self.special else n for p in self.parts.split(text) for n in ([None] if p in self.special else self._plain(p))]
        else:
            found = list(self._plain(text))
        return np.concatenate([*found, np.array([end_id], np.int32)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc_id", "ids", "start", "tokens")

    def __init__(self, doc_id: int | None, start: int, tokens: int, ids: np.ndarray) -> None:
        self.doc_id, self.start, self.tokens, self.ids = doc_id, start, tokens, ids

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.tokens, self.ids[:n]), Piece(self.doc_id, self.start + n, self.tokens, self.ids[n:])


class Bin:
    """Pieces that share a sequence."""

    def __init__(self, capacity: int) -> None:
        self.pieces: list[Piece] = []
        self.gap = capacity

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.gap -= len(piece)


class Packer:
    """The bins of one task; finished sequences go to out, as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.open: dict[int, Bin] = {}  # by class
        self.waiting: list[Bin] = []  # full by count; the fullest first
        self.short: list[Piece] = []  # whole documents of the stock, by length
        self.rests: list[Piece] = []  # what is left of cut ones
        self.stock = 0
        self.out: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        piece = Piece(doc_id, 0, len(ids), ids)
        while len(piece) > self.capacity:
            whole, piece = piece.cut(self.capacity)
            self.out.append([whole])
        if piece.start:
            self._store(piece)
        else:
            k = self.capacity // len(piece)
            if k > CLASSES:
                self._store(piece)
            else:
                bin_ = self.open.setdefault(k, Bin(self.capacity))
                bin_.put(piece)
                if len(bin_.pieces) == k:
                    del self.open[k]
                    self._wait(bin_)
        while len(self.waiting) > WAITING or self.stock > STOCK * self.capacity:
            self._fill(self.waiting.pop(0) if self.waiting else Bin(self.capacity))

    def _store(self, piece: Piece) -> None:
        self.stock += len(piece)
        if piece.start:
            self.rests.append(piece)
        else:
            insort(self.short, piece, key=len)

    def _wait(self, bin_: Bin) -> None:
        if bin_.gap:
            insort(self.waiting, bin_, key=lambda b: b.gap)
        else:
            self.out.append(bin_.pieces)

    def _taken(self, gap: int) -> Piece | None:
        """Out of the stock: the longest whole document that fits, else one to cut."""
        at = bisect_right(self.short, gap, key=len)
        if at:
            piece = self.short.pop(at - 1)
        elif self.rests or self.short:
            piece = (self.rests or self.short).pop()
        else:
            return None
        self.stock -= len(piece)
        return piece

    def _fill(self, bin_: Bin) -> None:
        """Fills the bin to the last id; without stock, waiting bins are dissolved for it, and what
        is then still short goes back to the stock."""
        while bin_.gap:
            piece = self._taken(bin_.gap)
            if piece is None:
                if not self.waiting:
                    for p in bin_.pieces:
                        self._store(p)
                    return
                # the bin with the most, and so the shortest, documents
                for p in self.waiting.pop(max(range(len(self.waiting)), key=lambda i: len(self.waiting[i].pieces))).pieces:
                    self._store(p)
                continue
            if len(piece) > bin_.gap:
                piece, rest = piece.cut(bin_.gap)
                self._store(rest)
            bin_.put(piece)
        self.out.append(bin_.pieces)

    def finish(self) -> None:
        """Packs all that is left; the last ids go to sequences as long as powers of two."""
        for bin_ in self.open.values():
            self._wait(bin_)
        self.open = {}
        while self.waiting:
            self._fill(self.waiting.pop(0))
        while self.stock >= self.capacity:
            self._fill(Bin(self.capacity))
        while self.stock:
            bin_ = Bin(1 << (self.stock.bit_length() - 1))
            self._fill(bin_)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the
    ids. docs: doc_id, text. capacity must be a power of two."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    names = [f.name for f in SCHEMA.fields]

    def rows(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
        pieces = [p for s in sequences for p in s]
        lengths = np.array([len(p) for p in pieces], np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        of = np.repeat(np.arange(len(sequences)), sizes)
        opening = starts[np.cumsum(sizes) - sizes] if len(sequences) else starts
        ids = np.concatenate([p.ids for p in pieces]) if pieces else np.zeros(0, np.int32)
        crc = [zlib.crc32(p.ids.astype("<u4", copy=False)) for p in pieces]
        columns = [
            pa.array([p.doc_id for p in pieces], pa.int64()), pa.array([p.start for p in pieces], pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()),
            pa.array([p.tokens for p in pieces], pa.int64()), pa.array(first + of, pa.int64()), pa.array(starts - opening[of] if len(pieces) else starts, pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)),
        ]
        return pa.record_batch(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer_path), Packer(capacity)
        next_id = TaskContext.get().partitionId() * TASK_SPAN
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode.ids(text.as_py() or "", end_id))
                if len(packer.out) * capacity >= _BATCH:
                    done, packer.out = packer.out, []
                    for at in range(0, len(done), _BATCH // capacity or 1):
                        part = done[at : at + (_BATCH // capacity or 1)]
                        yield rows(part, next_id)
                        next_id += len(part)
        packer.finish()
        yield rows(packer.out, next_id)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
