"""Near-duplicates at the similarity itself."""

import random

import numpy as np

from tests.llm import helpers as H
from tidalspan.llm import jaccard, simhash


def near_pairs(count, changed, seed):
    """Pairs of texts of 90 shingles each, of which changed are not shared: 10 is 0.8 exactly, 11 is 0.78."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    out = []
    for _ in range(count):
        ws = [word() for _ in range(94)]
        out.append((" ".join(ws), " ".join([*ws[:-changed], *(word() for _ in range(changed))])))
    return out


def kept_of(spark, texts):
    return {r["doc_id"] for r in simhash.first_of_groups(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], H.SCHEMA)).collect()}


def test_near_dedup_decides_by_the_similarity(spark):
    texts = [t for p in near_pairs(40, 10, 1) + near_pairs(40, 11, 2) for t in p]
    assert kept_of(spark, texts) == set(range(len(texts))) - set(range(1, 80, 2))


def test_comparison_over_tiles(spark):
    """Pieces cut into tiles link as whole pieces do."""
    texts = [t for p in near_pairs(30, 10, 3) + near_pairs(10, 11, 4) for t in p]
    sets = [np.unique(simhash.near_shingles(t)) for t in texts]
    rows = [(0, k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "piece long, node long, size long, payload binary")
    for tile in (10**9, 900):
        found = jaccard.edges(frame, frame["size"], tile, 0.8, jaccard.by_sets).collect()
        assert {(r["u"], r["v"]) for r in found} == {(k + 1, k) for k in range(0, 60, 2)}


def test_near_dedup_misses_no_pair_of_many_nodes(spark, monkeypatch):
    """Above a tile of nodes too, every pair at the similarity is found: against brute force."""
    monkeypatch.setattr(simhash, "TILE", 8)  # fingerprints were dealt to buckets by tiles of nodes
    monkeypatch.setattr(jaccard, "BUCKET_TILE", 8)
    common = " ".join(H.texts()[3][1].split()[20:75])
    texts = [t for p in near_pairs(600, 10, 5) for t in p] + [f"{common} {a} {common}" for p in near_pairs(20, 14, 6) for a in p]
    sets = [set(simhash.near_shingles(t).tolist()) for t in texts]
    holders, root = {}, list(range(len(texts)))
    for k, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(k)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in {(a, b) for g in holders.values() for b in g for a in g if a < b}:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert kept_of(spark, texts) == {k for k in range(len(texts)) if find(k) == k}


def test_near_dedup_links_by_fingerprints_in_tiles(spark, monkeypatch):
    """Without the prefix filter, what fingerprints of NEAR_RADIUS bits join in tiles still goes,
    where the sets agree, and nothing else."""
    texts = [t for p in near_pairs(40, 2, 8) + near_pairs(40, 10, 9) + near_pairs(40, 11, 10) for t in p]
    texts += ["w " * 200 + "end", "w " * 300 + "end"]  # one set, two texts
    sets = [set(simhash.near_shingles(t).tolist()) for t in texts]
    fps = [simhash.simhash(simhash.near_shingles(t)) for t in texts]
    bits = [((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(fps, fps[1:], strict=False)]
    near = [k for k in range(0, 240, 2) if bits[k] <= simhash.NEAR_RADIUS]
    alike = {k for k in near if 10 * len(sets[k] & sets[k + 1]) >= 8 * len(sets[k] | sets[k + 1])}
    assert {k // 80 for k in alike} == {0, 1} and len(alike) < min(len(near), 80)
    with monkeypatch.context() as m:
        m.setattr(jaccard, "candidates", lambda docs, *_: spark.createDataFrame([], "u long, v long"))
        assert kept_of(spark, texts) == set(range(242)) - {k + 1 for k in alike} - {241}
    assert kept_of(spark, texts) == set(range(242)) - set(range(1, 160, 2)) - {241}


def test_known_links_leave_the_prefix_filter_less(spark):
    """Hashes that one known group alone shares are no buckets; those of two groups are."""
    texts = [t for p in near_pairs(6, 2, 11) for t in p]
    rows = [(k, t, jaccard.name_of(np.unique(simhash.near_shingles(t)))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "_h long, text string, node long").cache()

    def found(known):
        known = spark.createDataFrame([(max(p), min(p)) for p in known], "u long, v long")
        return {(r["u"], r["v"]) for r in jaccard.candidates(docs, simhash.near_shingles, docs.select("node", "_h"), 0.8, known).collect()}

    pairs = [(rows[k][2], rows[k + 1][2]) for k in range(0, 12, 2)]
    assert found([]) == {(max(p), min(p)) for p in pairs}
    assert found(pairs[:4]) == {(max(p), min(p)) for p in pairs[4:]}
    known = [(max(p), min(p)) for p in pairs[4:]]
    roots = jaccard.exact_roots(docs, simhash.near_shingles, docs.select("node", "_h"), 0.8, spark.createDataFrame(known, "u long, v long")).collect()
    assert {(r["u"], r["v"]) for r in roots} == {(max(p), min(p)) for p in pairs}


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(1)
    levels = rng.integers(0, 9, 1 << jaccard.SLOT_BITS).astype(np.uint8)
    for n in (1, 4, 5, 9, 45, 90, 1000):
        for _ in range(50):
            m = int(n / 9) if n % 9 == 0 else int(n * 0.11)
            h = np.unique(rng.integers(0, 2**64 - 1, n + m, dtype=np.uint64))
            a, b = h[rng.permutation(len(h))[: len(h) - m]], h
            b = np.sort(np.concatenate([np.setdiff1d(h, a), rng.permutation(a)[: len(a) - m]])) if m else np.sort(a)
            a = np.sort(a)
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9:
                assert len(np.intersect1d(jaccard.prefix(a, levels, 0.8), jaccard.prefix(b, levels, 0.8)))
