"""Exact top-k by inner product: best-first search in a paged M-tree.

Vectors are quantised to integers. Equal vectors are one entry with the smallest ids it can
ever need. The tree has three kinds of pages, all with a covering radius around a centre:

* a unit, of at most UNIT entries, is an M-tree of its own: nodes with a routing object, a covering
  radius and the distance to the parent's; leaves hold the entries' vectors with their distances.
  A cell of more entries is split around pivots of its own, again and again, until none is;
* a directory lists the units below one of the root's cells, with their centres and radii;
* the root lists at most MAX_PIVOTS cells for each length of vectors.

Units and directories are built once and written as files; tasks read the ones that they need.

For a query q, an entry x below a page with centre p and radius r has <q, x> <= <q, p> + |q| r.
Each query goes first to its best unit (the best cell's best unit), which gives it a good k-th
score. That score is its threshold for the rest: the root and the directories drop every (query,
unit) pair whose bound is below it, before anything is shuffled, and what is left is dealt to
tasks in ranges of (unit, query), so that a unit that many queries want fills several tasks. In a
unit, pages are taken best first, and two bounds come before any product: a child's own bound is
at most <q, parent> + |q| (distance to parent + radius), and a leaf entry's at most <q, p> + |q|
(stored distance); what they exclude is never computed.
Queries that want the same unit are searched together: a page's products are one multiplication.

Queries are a stated set against all rows. The index covers every row and is exact: samples only
choose pivots (of SAMPLE rows for the root, of about SPLIT_SAMPLE rows in a cell that is split).

Cases: vectors that are null, or hold null or non-finite components, take no part, neither as
queries nor as candidates; empty vectors and vectors of other lengths only meet their like;
repeated ids are candidates each, but none with the query's own id; ties go to the smaller id;
an empty table gives no rows; further columns are ignored; components so large that a score
might not fit in 63 bits raise a ValueError.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidalspan.llm import storage, words

TOP = 5
SCALE = 256
UNIT = 4096
PAGE = 64
FANOUT = 16
SAMPLE = 4096
MAX_PIVOTS = 256
#: A crowded cell is split around so many pivots at most, out of about so many sampled rows.
SPLIT, SPLIT_SAMPLE = 64, 256
#: Pairs of a query and a unit that a task takes, about.
TASK_PAIRS = 1 << 14
#: Queries that are searched together in a unit.
QUERIES = 256
SEED = 42


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q: floor(scale * x) of every vector that takes part."""
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return rows.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """q, ids: a row for each distinct vector with its keep smallest distinct ids, each as often as
    it occurs, keep times at most."""
    # in two steps, so that many copies of one vector are first counted and thinned where they are
    every = W.partitionBy("q").orderBy("vec_id")
    counted = vectors.groupBy("q", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(keep)).cast("int").alias("_times"))
    thin = counted.withColumn("_n", F.row_number().over(every)).where(F.col("_n") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("vec_id", "_times")))
    return thin.groupBy("q").agg(F.flatten(F.transform(listed, lambda x: F.array_repeat(x["vec_id"], x["_times"]))).alias("ids"))


class Files:
    """Pages as files under a folder that all executors share; whole from the moment they have their name."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.opened = None

    def __getstate__(self) -> str:
        return self.folder

    def __setstate__(self, folder: str) -> None:
        self.folder, self.opened = folder, None

    def _at(self):
        from pyarrow import fs

        if self.opened is None:
            self.opened = fs.FileSystem.from_uri(self.folder)
        return self.opened

    def put(self, name: str, page: object) -> None:
        from pyarrow import fs

        system, at = self._at()
        final, temporary = f"{at}/{name}", f"{at}/.{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as out:
            out.write(pickle.dumps(page, protocol=5))
        if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(final).type != fs.FileType.NotFound:
            system.delete_file(final)  # another attempt's; some stores do not rename onto a file
        system.move(temporary, final)

    def get(self, name: str) -> object:
        system, at = self._at()
        with system.open_input_stream(f"{at}/{name}") as found:
            return pickle.loads(found.read())


def root_pivots(found: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By length: at most MAX_PIVOTS vectors out of a sample."""
    wanted = int(min(MAX_PIVOTS, max(1, count // (UNIT // 2))))
    by_length: dict[int, list] = {}
    for r in found.select("q").orderBy(F.xxhash64("q"), "q").limit(SAMPLE).collect():
        own = by_length.setdefault(len(r["q"]), [])
        if len(own) < wanted:
            own.append(r["q"])
    return {n: np.array(own, np.float64).reshape(len(own), n) for n, own in by_length.items()}


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (points * points).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
    return d.argmin(axis=1)


def with_cell(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (which have q) with cell: their length and nearest pivot."""
    names, schema = rows.columns, T.StructType([*rows.schema.fields, T.StructField("cell", T.StringType())])
    at = names.index("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(at).to_pylist()
            cells = np.empty(len(found), object)
            for n in {len(q) for q in found}:
                own = np.array([k for k, q in enumerate(found) if len(q) == n])
                near = _nearest(np.array([found[k] for k in own], np.float64).reshape(len(own), n), pivots[n]) if n in pivots else np.zeros(len(own), int)
                cells[own] = [f"{n}.{j}" for j in near.tolist()]
            yield pa.record_batch([*batch.columns, pa.array(cells.tolist(), pa.string())], names=[*names, "cell"])

    return rows.mapInArrow(run, schema)


class Page:
    """A node: its routing object, covering radius, distance to the parent, and children or entries."""

    __slots__ = ("children", "distances", "entries", "object", "objects", "parent", "radii", "radius", "reach")

    def __init__(self, points: np.ndarray, own: np.ndarray, parent: np.ndarray | None) -> None:
        inside = points[own]
        self.object = inside.mean(axis=0)
        d = np.sqrt(((inside - self.object) ** 2).sum(axis=1))
        self.radius = float(d.max()) if len(d) else 0.0
        self.parent = float(np.sqrt(((self.object - parent) ** 2).sum())) if parent is not None else 0.0
        self.children: list[Page] = []
        self.entries = self.distances = self.objects = self.radii = self.reach = None
        if len(own) <= PAGE:
            order = np.argsort(-d, kind="stable")
            self.entries, self.distances = own[order], d[order]
            return
        # routing objects of the children: far points, then the nearest of them takes each entry
        chosen, gap = [int(d.argmax())], None
        while len(chosen) < FANOUT:
            far = ((inside - inside[chosen[-1]]) ** 2).sum(axis=1)
            gap = far if gap is None else np.minimum(gap, far)
            if gap.max() <= 0:
                break
            chosen.append(int(gap.argmax()))
        label = _nearest(inside, inside[chosen])
        groups = [own[label == k] for k in range(len(chosen))]
        if max(map(len, groups)) == len(own):  # all but equal points: cut by number
            groups = np.array_split(own, -(-len(own) // PAGE))
        self.children = [Page(points, g, self.object) for g in groups if len(g)]
        self.objects, self.radii = np.array([c.object for c in self.children]), np.array([c.radius for c in self.children])
        self.reach = self.radii + [c.parent for c in self.children]


class Tree:
    """The M-tree of one unit."""

    def __init__(self, points: np.ndarray, root: Page | None = None) -> None:
        self.exact = points
        self.points = points.astype(np.float64)
        self.root = root or Page(self.points, np.arange(len(points)), None)
        # floats give the products exactly while these stay below 2**53
        self.safe = float(np.abs(self.points).max(initial=0)) ** 2 * max(1, points.shape[1]) < 2**52

    def scores(self, own: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A row for each of own, a column for each query."""
        if self.safe:
            return (self.points[own] @ q.astype(np.float64).T).astype(np.int64)
        return self.exact[own] @ q.T

    def search(self, q: np.ndarray, ids: list[list[int]], skip: int, k: int, threshold: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) without the id skip; what scores below threshold may be left out."""
        return self.search_all(q[None, :], ids, [skip], k, [threshold])[0]

    def search_all(self, q: np.ndarray, ids: list[list[int]], skips: list[int], k: int, thresholds: list[int | None]) -> list[list[tuple[int, int]]]:
        """The same for each row of q. A page is taken once, for the queries that its bound leaves, and
        pages in the order of their best bounds."""
        best: list[list[tuple[int, int]]] = [[] for _ in skips]  # heaps of (score, -id)
        points = q.astype(np.float64)
        norm = np.sqrt((points * points).sum(axis=1)) * (1 + 1e-9)
        slack = 1e-6 * (1 + norm)
        floor = np.array([-np.inf if t is None else t for t in thresholds], np.float64)
        product = points @ self.root.object
        bound = product + norm * self.root.radius + slack
        queue = [(-float(bound.max(initial=0)), 0, self.root, np.arange(len(points)), product, bound)]
        pushed = 1
        while queue:
            _, _, page, own, product, bound = heapq.heappop(queue)
            still = bound >= floor[own]
            if not still.all():
                own, product = own[still], product[still]
            if not len(own):
                continue
            if page.entries is None:
                # what stored distances exclude for all queries is never computed
                fit = np.flatnonzero(((product + slack[own])[:, None] + norm[own][:, None] * page.reach[None, :] >= floor[own][:, None]).any(axis=0))
                inner = points[own] @ page.objects[fit].T
                bound = inner + norm[own][:, None] * page.radii[fit][None, :] + slack[own][:, None]
                wanted = bound >= floor[own][:, None]
                for at, child in enumerate(fit.tolist()):
                    mine = wanted[:, at]
                    if mine.any():
                        heapq.heappush(queue, (-float(bound[mine, at].max()), pushed, page.children[child], own[mine], inner[mine, at], bound[mine, at]))
                        pushed += 1
                continue
            # distances fall, so the entries that can reach a floor come first
            least = float(((floor[own] - product - slack[own]) / np.maximum(norm[own], 1e-300)).min())
            inside = page.entries[: int(np.searchsorted(-page.distances, -least, side="right"))] if least > 0 else page.entries
            if not len(inside):
                continue
            found = self.scores(inside, q[own])
            for at, mine in np.argwhere(found >= floor[own][None, :]).tolist():
                query, score = int(own[mine]), int(found[at, mine])
                held = best[query]
                if len(held) == k and score < held[0][0]:
                    continue
                for vec_id in ids[inside[at]]:
                    if vec_id == skips[query]:
                        continue
                    if len(held) < k:
                        heapq.heappush(held, (score, -vec_id))
                    elif (score, -vec_id) > held[0]:
                        heapq.heapreplace(held, (score, -vec_id))
                    else:
                        break
                if len(held) == k and held[0][0] > floor[query]:
                    floor[query] = held[0][0]
        return [sorted(((s, -i) for s, i in held), key=lambda r: (-r[0], r[1])) for held in best]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    n = len(lists)
    return lists.flatten().to_numpy().reshape(n, -1) if n and len(lists[0]) else np.zeros((n, 0), np.int64)


def _small(points: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them."""
    top = int(np.abs(points).max(initial=0))
    return points.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


_UNITS = pa.schema([("cell", pa.string()), ("top", pa.string()), ("length", pa.int32()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])
_FOUND = pa.schema([("query_id", pa.int64()), ("qkey", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "query_id long, qkey long, vec_id long, score long"
_ASKED = pa.schema([("unit", pa.string()), ("query_id", pa.int64()), ("qkey", pa.int64()), ("q", pa.list_(pa.int64())), ("threshold", pa.int64())])
_ASKED_DDL = "unit string, query_id long, qkey long, q array<bigint>, threshold long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """The pages over all rows of vectors (vec_id, q)."""

    def __init__(self, vectors: DataFrame, k: int = TOP) -> None:
        self.k = k
        # k others and the query itself are the most that a search can want of equal vectors
        distinct = storage.stored(entries(vectors, k + 1), "mtree-entries")
        top = distinct.agg(F.count(F.lit(1)), F.max(F.aggregate("q", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))), F.max(F.size("q"))).first()
        if top[0] and top[1] ** 2 * top[2] >= 2.0**62:
            raise ValueError("scores of vectors this large may not fit in 63 bits")
        self.files = Files(storage.new_folder(vectors.sparkSession, "mtree-pages"))
        cells = self._split(with_cell(distinct, root_pivots(distinct, top[0])))
        units = storage.stored(cells.groupBy("cell").applyInArrow(self._build(), "cell string, top string, length int, n long, centre array<double>, radius double"), "mtree-units")
        found = units.groupBy("top").applyInArrow(self._list(), "cell string, top string, length int, n long, centre array<double>, radius double").toArrow()  # at most MAX_PIVOTS rows a length
        self.root: dict[int, tuple[list[str], np.ndarray, np.ndarray]] = {}
        for n in sorted(set(found.column("length").to_pylist())):
            own = found.filter(pa.compute.equal(found.column("length"), n)).sort_by("top")
            self.root[n] = (own.column("top").to_pylist(), _matrix(own.column("centre").combine_chunks()).astype(np.float64), own.column("radius").to_numpy())

    def _split(self, cells: DataFrame) -> DataFrame:
        """Entries with the names of cells that have at most UNIT of them."""
        files, unit = self.files, UNIT
        rows, whole = storage.stored(cells, "mtree-cells"), []
        while True:
            sizes = storage.stored(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "mtree-sizes")
            crowded = sizes.where(F.col("n") > unit)
            if crowded.isEmpty():
                break
            whole.append(rows.join(sizes.where(F.col("n") <= unit).select("cell"), "cell"))

            def choose(table: pa.Table) -> pa.Table:
                """Writes a cell's pivots: entries, so that each of them gets a part."""
                cell, n = table.column("cell")[0].as_py(), table.column("n")[0].as_py()
                points = _matrix(table.column("q").combine_chunks())
                order = np.lexsort(points.T[::-1]) if points.shape[1] else np.arange(len(points))
                chosen = np.random.default_rng(SEED).permutation(order)[: min(SPLIT, max(2, -(-2 * n // unit)))]
                files.put(f"{cell}.pivots", points[chosen].astype(np.float64))
                return pa.table({"cell": [cell], "n": [len(chosen)]})

            def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held, pivots = None, None
                for batch in batches:
                    names = np.array(batch.column("cell").to_pylist(), object)
                    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if a == b:
                            continue
                        if names[a] != held:
                            held, pivots = names[a], files.get(f"{names[a]}.pivots")
                        part = batch.slice(a, b - a)
                        near = _nearest(_matrix(part.column("q")).astype(np.float64), pivots)
                        yield pa.record_batch([part.column("q"), part.column("ids"), pa.array([f"{held}.{j}" for j in near.tolist()])], names=["q", "ids", "cell"])

            few = F.pmod(F.xxhash64("q", "cell"), F.ceil(F.col("n") / SPLIT_SAMPLE)) == 0
            made = rows.join(crowded, "cell").where(few).select("cell", "n", "q").groupBy("cell").applyInArrow(choose, "cell string, n long")
            chosen = storage.stored(made, "mtree-pivots")
            # a sample may be empty by chance: the cell waits for the next round's, unless it is small
            missed = crowded.join(chosen.select("cell"), "cell", "left_anti")
            if not missed.isEmpty():
                every = rows.join(missed, "cell").withColumn("_r", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("q")))).where(F.col("_r") <= SPLIT_SAMPLE)
                storage.stored(every.select("cell", "n", "q").groupBy("cell").applyInArrow(choose, "cell string, n long"), "mtree-pivots")
            dealt = rows.join(crowded.select("cell"), "cell").select("q", "ids", "cell").repartitionByRange(words.partitions(rows.sparkSession), "cell", F.xxhash64("q")).sortWithinPartitions("cell")
            rows = storage.stored(dealt.mapInArrow(assign, rows.select("q", "ids", "cell").schema), "mtree-cells")
        whole.append(rows)
        out = whole[0].select("q", "ids", "cell")
        for more in whole[1:]:
            out = out.unionByName(more.select("q", "ids", "cell"))
        return out

    def _build(self):
        files = self.files

        def run(table: pa.Table) -> pa.Table:
            """Writes a unit."""
            cell, points = table.column("cell")[0].as_py(), _matrix(table.column("q").combine_chunks())
            order = np.lexsort(points.T[::-1]) if points.shape[1] else np.arange(len(points))
            ids = table.column("ids").to_pylist()
            tree = Tree(points[order])
            files.put(f"{cell}.unit", (_small(tree.exact), tree.root, [ids[k] for k in order.tolist()]))
            top = ".".join(cell.split(".")[:2])
            return pa.Table.from_pylist([{"cell": cell, "top": top, "length": points.shape[1], "n": len(points), "centre": tree.root.object.tolist(), "radius": tree.root.radius}], schema=_UNITS)

        return run

    def _list(self):
        files = self.files

        def run(table: pa.Table) -> pa.Table:
            """Writes the directory of one of the root's cells."""
            table = table.sort_by("cell")
            top, centres, radii = table.column("top")[0].as_py(), _matrix(table.column("centre").combine_chunks()).astype(np.float64), table.column("radius").to_numpy()
            files.put(f"{top}.directory", (table.column("cell").to_pylist(), centres, radii))
            centre = centres.mean(axis=0)
            radius = float((np.sqrt(((centres - centre) ** 2).sum(axis=1)) + radii).max()) * (1 + 1e-9)
            return pa.Table.from_pylist([{"cell": None, "top": top, "length": centres.shape[1], "n": len(radii), "centre": centre.tolist(), "radius": radius}], schema=_UNITS)

        return run

    def _route(self, asked: DataFrame, best: bool) -> DataFrame:
        """(unit, query) pairs: best, of the one unit that looks best; else of every unit whose bound
        reaches the query's threshold, but the one in skip. asked: query_id, qkey, q, threshold, skip."""
        root, files = self.root, self.files

        def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            inner = q @ centres.T
            norm = np.sqrt((q * q).sum(axis=1))[:, None] * (1 + 1e-9)
            return inner, inner + norm * radii[None, :] + 1e-6 * (1 + norm)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column("q").value_lengths().to_numpy()
                for n in np.unique(lengths).tolist():
                    if n not in root:
                        continue
                    part = batch.filter(pa.array(lengths == n))
                    q = _matrix(part.column("q")).astype(np.float64)
                    floor = part.column("threshold").fill_null(-(1 << 63)).to_numpy().astype(np.float64)
                    skip = np.array(part.column("skip").to_pylist(), object)
                    tops, centres, radii = root[n]
                    inner, bound = bounds(q, centres, radii)
                    wanted = inner == inner.max(axis=1, keepdims=True) if best else bound >= floor[:, None]
                    if best:  # the first of equals
                        wanted &= np.cumsum(wanted, axis=1) == 1
                    for cell in np.flatnonzero(wanted.any(axis=0)).tolist():
                        names, centres, radii = files.get(f"{tops[cell]}.directory")
                        mine = np.flatnonzero(wanted[:, cell])
                        inner, bound = bounds(q[mine], centres, radii)
                        if best:
                            rows, units = np.arange(len(mine)), inner.argmax(axis=1)
                        else:
                            rows, units = np.nonzero(bound >= floor[mine][:, None])
                        chosen = np.array(names, object)[units]
                        if not best:
                            other = chosen != skip[mine[rows]]
                            rows, chosen = rows[other], chosen[other]
                        for at in range(0, len(rows), 4096):
                            some = part.take(pa.array(mine[rows[at : at + 4096]]))
                            yield pa.record_batch([pa.array(chosen[at : at + 4096].tolist(), pa.string()), *(some.column(c) for c in ("query_id", "qkey", "q", "threshold"))], schema=_ASKED)

        return asked.select("query_id", "qkey", "q", "threshold", "skip").mapInArrow(run, _ASKED_DDL)

    def _search(self, routed: DataFrame) -> DataFrame:
        files, k = self.files, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, tree, ids = None, None, None
            for whole in batches:
                names = np.array(whole.column("unit").to_pylist(), object)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                out: list[tuple] = []
                for at, end in zip(cuts, cuts[1:], strict=False):
                    if at < end and names[at] != held:
                        exact, page, ids = files.get(f"{names[at]}.unit")
                        held, tree = names[at], Tree(exact.astype(np.int64), page)
                    for a in range(at, end, QUERIES):
                        part = whole.slice(a, min(QUERIES, end - a))
                        asked, keys = part.column("query_id").to_pylist(), part.column("qkey").to_pylist()
                        found = tree.search_all(_matrix(part.column("q")), ids, asked, k, part.column("threshold").to_pylist())
                        out += [(query_id, qkey, i, s) for query_id, qkey, best in zip(asked, keys, found, strict=True) for s, i in best]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)

        parts = max(words.partitions(routed.sparkSession), routed.count() // TASK_PAIRS)  # work, not bytes, is what a task is full of
        return routed.repartitionByRange(parts, "unit", "qkey").sortWithinPartitions("unit").mapInArrow(run, _FOUND_DDL)

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score. queries: query_id, q; a row each."""
        none = F.lit(None)
        asked = storage.stored(queries.select("query_id", "q").withColumn("qkey", F.monotonically_increasing_id()), "mtree-queries")
        routed = storage.stored(self._route(asked.select("*", none.cast("long").alias("threshold"), none.cast("string").alias("skip")), True), "mtree-routed")
        first = storage.stored(self._search(routed), "mtree-first")
        kth = _best(first, self.k).groupBy("qkey").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select("qkey", F.when(F.col("n") >= self.k, F.col("s")).alias("threshold"))
        rest = routed.select("qkey", "query_id", "q", F.col("unit").alias("skip")).join(kth, "qkey", "left")
        pairs = storage.stored(self._route(rest, False), "mtree-pairs")
        found = first.unionByName(self._search(pairs))
        return _best(found, self.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    vectors = storage.stored(rows, "mtree-vectors")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "q")
    return Index(vectors).search(queries)
