"""Toxicity: a second-order factorization machine over hashed terms.

A text's terms are its distinct lower-cased words without ASCII punctuation and digits, and the
stems (first STEM letters) of the longer ones, so that unseen forms of a word count too. Each is
hashed to one of BUCKETS places; a place has a linear weight and FACTORS interaction weights,
so that a pair of terms (an insult and the group it is aimed at) can weigh more, or less, than
the sum of both.

Which terms get weights is decided by evidence, as the pairs of a long text's many rare words
would outweigh everything else. A term counts that stands in at least LEAST_DOCS training texts,
and with label 1 more or less often than chance allows (LEAST_Z standard deviations). A pair
counts, whatever its terms tell alone, if label 1 is more or less frequent beside both than the
two add up to (LEAST_PAIR_Z deviations, in LEAST_PAIR_DOCS texts with both and with each alone);
all pairs of the PAIR_TERMS most frequent terms are tried, and both terms of such a pair get
weights. Their interaction weights start from the leading eigenvectors of that evidence.

Training reads at most TRAIN_DOCS labelled ids, the ones with the smallest hash, one row each. The
driver fits the machine on them, with the terms that may count alone: those that tell by
themselves and the PAIR_TERMS most frequent, which Spark counts. Scoring is one map over all rows with the finished weights (5 MB, whatever the input).

Cases: null and empty texts have no terms and get the bias's score; null labels are not learnt
from; of several labels of one document the highest holds, and of several rows of one labelled
id the one with the least terms; a null doc_id counts as not held out and is never learnt from;
without any usable label every score is LOW_PRIOR; very long texts count each term once, like
others; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm import storage

BUCKETS = 1 << 18
FACTORS = 4
LEAST_DOCS = 5
LEAST_Z = 3.5
PAIR_TERMS = 1024
LEAST_PAIR_DOCS = 30
LEAST_PAIR_Z = 6.0
#: Steps that a fit takes at least, whatever the number of rows.
LEAST_STEPS = 400
STEM = 4
TRAIN_DOCS = 20_000
THRESHOLD = 0.3
LOW_PRIOR = 0.05
SEED = 42

_TABLE = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
_CACHE_WORDS = 400_000


class Places(dict):
    """word -> place; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        place = self[word] = xxhash.xxh32_intdigest(word) % (BUCKETS - 1) + 1
        return place


def terms(text: str | None, places: Places) -> list[int]:
    """Places of the text's distinct terms."""
    if not text:
        return []
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())
    return sorted({places[w] for w in words} | {places[b"\0" + w[:STEM]] for w in words if len(w) > STEM})


def _rate(share: float) -> float:
    """A share of ones, away from 0 and 1."""
    return min(max(share, 1e-3), 0.999)


def pair_evidence(rows: list[np.ndarray], y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of known that tell in a pair, and how much each two of them do (0: not enough)."""
    n = len(known)
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(n)
    both, ones = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for at in range(0, len(rows), 1024):
        part = [number[r] for r in rows[at : at + 1024]]
        x = np.zeros((len(part), n), np.float32)
        for line, found in zip(x, part, strict=True):
            line[found[found >= 0]] = 1
        both += x.T @ x
        toxic = x[y[at : at + 1024] > 0]
        ones += toxic.T @ toxic
    seen, told = both.diagonal().copy(), ones.diagonal().copy()
    shape, total, all_told = both.shape, np.float32(len(rows)), np.float32(y.sum())
    contrast, variance, enough = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.ones(shape, bool)
    one, other = np.broadcast_to(seen[:, None], shape), np.broadcast_to(told[:, None], shape)
    cells = (  # texts with both, with either alone, with none: how many, and how many of label 1
        (1, both, ones), (-1, one - both, other - ones), (-1, one.T - both, other.T - ones),
        (1, total - one - one.T + both, all_told - other - other.T + ones),
    )
    for sign, count, label in cells:
        enough &= count >= LEAST_PAIR_DOCS
        rate = (label + 1) / (count + 2)
        contrast += sign * label / np.maximum(count, 1)
        variance += rate * (1 - rate) / np.maximum(count, 1)
    strong = enough & (np.abs(contrast) >= LEAST_PAIR_Z * np.sqrt(variance))
    np.fill_diagonal(strong, False)
    telling = np.flatnonzero(strong.any(axis=1))
    return known[telling], np.where(strong, contrast, 0)[np.ix_(telling, telling)]


class Machine:
    """Factorization machine with logistic loss, fitted by Adagrad over shuffled batches."""

    def __init__(self, factors: int = FACTORS, seed: int = SEED) -> None:
        self.bias = float(np.log(LOW_PRIOR / (1 - LOW_PRIOR)))
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = np.zeros((BUCKETS, factors), np.float32)
        self.seed = seed

    def _forward(self, flat: np.ndarray, starts: np.ndarray):
        # place 0 opens every text and weighs nothing, so that no text is empty
        v = self.v[flat]
        linear = np.add.reduceat(self.w[flat], starts)
        total = np.add.reduceat(v, starts, axis=0)
        pairs = 0.5 * ((total * total) - np.add.reduceat(v * v, starts, axis=0)).sum(axis=1)
        return v, total, self.bias + linear + pairs

    @staticmethod
    def _flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) + 1 for r in rows])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = np.zeros(int(sizes.sum()), np.int64)
        rest = np.ones(len(flat), bool)
        rest[starts] = False
        flat[rest] = np.concatenate([np.asarray(r, np.int64) for r in rows])
        return flat, starts, sizes

    def score(self, rows: list) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        flat, starts, _ = self._flat(rows)
        z = self._forward(flat, starts)[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _start(self, rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Sets the first weights; which places may have any."""
        seen, ones = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for row, one in zip(rows, y, strict=True):  # a row's places are distinct
            seen[row] += 1
            if one:
                ones[row] += 1
        rate = _rate(float(y.mean()))
        self.bias = float(np.log(rate / (1 - rate)))
        z = (ones - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
        kept = (seen >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
        frequent = np.argsort(-seen, kind="stable")[:PAIR_TERMS]
        paired, evidence = pair_evidence(rows, y, np.sort(frequent[seen[frequent] >= 2 * LEAST_PAIR_DOCS]))
        kept[paired] = True
        known = np.flatnonzero(kept)
        self.v[known] = rng.normal(0, 0.02, (len(known), self.v.shape[1]))
        if len(paired):
            size, direction = np.linalg.eigh(evidence)
            lead = np.argsort(-size)[: self.v.shape[1]]
            self.v[paired, : len(lead)] += direction[:, lead] * np.sqrt(np.maximum(size[lead], 0))
        return kept

    def fit(self, rows: list, labels: list[int], epochs: int = 12, batch: int = 256, rate: float = 0.08, decay: float = 2e-4) -> Machine:
        if not rows:
            return self
        rng = np.random.default_rng(self.seed)
        y = (np.array(labels) > 0).astype(np.float32)
        kept = self._start(rows, y, rng)
        rows = [r[kept[r]] for r in rows]
        gw, gv, gb = np.full(BUCKETS, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(rows)) if len(rows) > batch else epochs)):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                flat, starts, sizes = self._flat([rows[i] for i in part])
                v, total, z = self._forward(flat, starts)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
                of = np.repeat(np.arange(len(part)), sizes)
                used, where = np.unique(flat, return_inverse=True)
                dw = np.bincount(where, error[of], len(used)) / len(part) + decay * self.w[used]
                dv = np.stack([np.bincount(where, error[of] * (total[of, f] - v[:, f]), len(used)) for f in range(v.shape[1])], axis=1) / len(part) + decay * self.v[used]
                db = float(error.mean())
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += db * db
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                self.bias -= rate * db / gb**0.5
                self.w[0], self.v[0] = 0, 0
        return self


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """Fits on at most train_docs labelled rows that are not held out. docs: doc_id, text; labels: doc_id, toxic."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    )  # at most train_docs pairs of numbers: small enough to broadcast at any size of the input

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            found = [terms(t.as_py(), places) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "places"])

    every = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(places_of, "doc_id long, toxic int, places array<int>")
    )
    # one row an id, the one with the least terms, whatever the partitions are
    least = F.min(F.struct(F.size("places"), "places", "toxic")).alias("r")
    rows = storage.stored(every.groupBy("doc_id").agg(least).select("doc_id", "r.places", "r.toxic"), "toxicity-terms")
    # terms that cannot count stay out of the driver: those that tell alone, and the most frequent, go there
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    share = _rate(ones / n) if n else LOW_PRIOR
    each = rows.select(F.explode("places").alias("place"), (F.col("toxic") > 0).cast("int").alias("one")).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("ones"))
    counts = storage.stored(each.where(F.col("n") >= LEAST_DOCS), "toxicity-counts")  # BUCKETS rows at most
    z = (F.col("ones") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    telling = counts.where(F.abs(z) >= LEAST_Z - 1e-6).select("place").unionAll(counts.orderBy(F.desc("n"), "place").limit(PAIR_TERMS).select("place")).toArrow()
    may = np.zeros(BUCKETS, bool)
    may[telling.column("place").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(may)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            fit = shared.value[flat]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[fit], minlength=len(lists)))])
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[fit]))
            yield pa.record_batch([batch.column(0), kept, batch.column(2)], names=["doc_id", "places", "toxic"])

    found = rows.mapInArrow(thinned, rows.schema).toArrow().sort_by("doc_id")
    storage.drop(rows)
    storage.drop(counts)
    lists = found.column("places").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    return Machine().fit(np.split(flat, ends[:-1]) if len(ends) else [], found.column("toxic").to_pylist())


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then score: the probability of label 1, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    given = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = given.columns.index("text")
    places_kept = [(given.columns.index(c), c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, own = Places(), Machine()
        own.bias, own.w, own.v = shared.value
        live = (own.w != 0) | own.v.any(axis=1)
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                rows = [[p for p in terms(t.as_py(), places) if live[p]] for t in batch.column(at)]
                columns = [batch.column(i) for i, _ in places_kept]
                yield pa.record_batch([*columns, pa.array(own.score(rows), pa.float64())], names=[*(c for _, c in places_kept), "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return given.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
