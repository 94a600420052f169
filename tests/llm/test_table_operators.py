"""Mixing, URL filters, exact search, WARC and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidalspan.llm import mixing, mtree, queries, storage, url_filter, warc

# --- op 2


def taken(spark, rows, **kw):
    made, sizes = mixing.plan(H.docs(spark, rows), **kw)
    return mixing.draws(sizes, made).select("doc_id", "source", "size", "source_size", "target", "draws").collect()


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 30, 200]))), "en", "hot" if k % 3 else f"s{k % 9}", 0) for k in range(900)]
    rows += [(1000, None, None, None, None), (1001, "", None, "zero", 0), (5, "a b c", "en", "hot", 0), (5, "a b c", "en", "hot", 0)]
    got = taken(spark, rows)
    assert len(got) == len(rows)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(H.words(r[1])) for r in rows if r[3] == s) for s in sources}
    weights = [(3, 1, 2)[k % 3] for k in range(len(sources))]
    want = dict(zip(sources, mixing.targets([size[s] for s in sources], weights, 1.5 * sum(size.values())), strict=True))
    for s in sources:
        own = [r for r in got if r["source"] == s]
        assert {(r["source_size"], round(r["target"], 6)) for r in own} == {(size[s], round(want[s], 6))}
        assert abs(sum(d["words"] for r in own for d in r["draws"]) - want[s]) <= 2
    assert all(sum(d["words"] for d in r["draws"]) <= 2 * r["size"] for r in got)
    key = lambda found: sorted((str(r["doc_id"]), r["size"], [(d["shard"], d["words"]) for d in r["draws"]]) for r in found)
    assert key(got) == key(taken(spark, rows[::-1]))  # reruns agree, whatever the order of rows


@pytest.mark.parametrize("large", [50_000, 5])
def test_mixing_of_many_sources(spark, monkeypatch, large):
    """More sources than classes, and than are joined by broadcast: the same targets, met."""
    monkeypatch.setattr(mixing, "CLASSES", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", large)
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([1, 4, 50]), "en", f"s{rng.randint(0, 60) if k % 3 else 'hot'}", 0) for k in range(1500)] + [(9, "a b", None, None, None)]
    got = taken(spark, rows, shards=5)
    assert len(got) == len(rows)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(H.words(r[1])) for r in rows if r[3] == s) for s in sources}
    want = dict(zip(sources, mixing.targets([size[s] for s in sources], [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5 * sum(size.values())), strict=True))
    shards = [0] * 5
    for s in sources:
        own = [r for r in got if r["source"] == s]
        assert [r["target"] for r in own] == pytest.approx([want[s]] * len(own)) and abs(sum(d["words"] for r in own for d in r["draws"]) - want[s]) <= 2
    for r in got:
        for d in r["draws"]:
            shards[d["shard"]] += 1
    assert max(shards) < 2 * min(shards) and all(sum(d["words"] for d in r["draws"]) <= 2 * r["size"] for r in got)


def test_sources_are_numbered_over_partitions(spark):
    names = [None, "", "B", "a", "é", "🙂", "\ue000"] + [f"s{k}" for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.numbered(spark.createDataFrame([(n,) for n in names], "source string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["source"]: r["k"] for r in got} == {n: k for k, n in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def test_op2_and_mixed_on_odd_tables(spark, tmp_path):
    spark.createDataFrame(H.texts() + H.texts()[:3], H.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op2(spark, str(tmp_path)).collect()
    assert len(got) == len(H.texts()) + 3 and all(0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) <= 2 for r in got)
    H.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert mixing.op2(spark, f"{tmp_path}/none").count() == 0 and mixing.mixed(H.empty(spark), 3).count() == 0
    wide = H.docs(spark)
    assert mixing.mixed(wide, 3).columns == wide.columns


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.targets([0, 5], [1, 1], 7.5) == [0, 7.5] and mixing.targets([], [], 0) == []
    assert mixing.targets([1, 1], [1, 1], 100) == [2, 2]


def test_splitting_tree():
    leaves = mixing.split([1000, 0, 37], 7)
    assert [sum(x) for x in zip(*leaves, strict=True)] == [1000, 0, 37]
    totals = [sum(leaf) for leaf in leaves]
    assert max(totals) - min(totals) <= 4 and leaves == mixing.split([1000, 0, 37], 7)


def test_mix_rows(spark):
    rows = H.texts()
    out = mixing.mix(spark.createDataFrame(rows, H.SCHEMA), shards=4).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(r["text"] == text[r["doc_id"]] and 0 <= r["shard"] < 4 and r["words"] <= r["size"] for r in out)
    assert len({(r["doc_id"], r["turn"]) for r in out}) == len(out)
    assert mixing.mix(H.empty(spark)).count() == 0


# --- op 3


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = raw.translate(H.FOLD), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = []
    for verdict, rule in url_filter.RULES:
        name, _, p = rule.partition("/")
        if (host == name or host.endswith(f".{name}")) and path.startswith(f"/{p}"):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    "https://www.Example.ORG/en/196/", "http://example.org/es/1?x=1#y", "http://a.example.org/en/1", "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/fr", "http://com/de/z",
    "http://org", "http://org/", None, "", "no scheme", "://", "a://b://c.org/d", "http://É.COM/de/", "http://x.net/en/5?page=2&ref=x", "ftp://user@x.com:80/de/1", "http://x.org?y=/z", "HTTP://X.ORG/\nfr",
]


def test_url_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 4)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' as host", "'clash' as rule", "'c' as _suffix", "1 as f_length")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(rows)
    for k, u in rows:
        host, path, rule, verdict = brute_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] in ("allow", "block") and verdict in (None, got[k]["verdict"])


def test_url_trees_learn(spark):
    rng = random.Random(1)
    good = [f"http://{rng.choice(['blog', 'news', 'shop'])}{rng.randint(0, 9)}.net/a/{rng.choice('abc')}" for _ in range(150)]
    bad = [f"http://{''.join(rng.choices('0123456789abcdef', k=18))}.biz/{rng.randint(10**8, 10**9)}?a=1&b=2&c={k}" for k in range(150)]
    labelled = spark.createDataFrame([(u, 0) for u in good[:100]] + [(u, 1) for u in bad[:100]] + [(None, None)], "url string, label int")
    df = spark.createDataFrame([(k, u) for k, u in enumerate(good[100:] + bad[100:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, labelled=labelled, rules=()).collect()}
    assert np.mean([got[k] == ("allow" if k < 50 else "block") for k in got]) > 0.95


def test_url_trees_measure_themselves(spark):
    """A URL that is repeated a thousand times is one of the sample; the held-out fold is judged."""
    rng = random.Random(6)
    good = [f"http://{rng.choice(['blog', 'news', 'shop'])}{rng.randint(0, 9)}.net/a/{rng.choice('abc')}{k}" for k in range(300)]
    bad = [f"http://{''.join(rng.choices('0123456789abcdef', k=18))}.biz/{rng.randint(10**8, 10**9)}?a=1&b=2&c={k}" for k in range(300)]
    labelled = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad] + [(good[0], 0)] * 1000, "url string, label int")
    rows = url_filter._with_features(labelled, ["label"], ())
    names = [c for c in rows.columns if c.startswith("f_")]
    trees = url_filter.Trees(rows.select(*url_filter.SUFFIXES, "label", F.xxhash64("_url").alias("hash_key"), *names), train_urls=500)
    assert trees.measured() > 0.95
    assert trees.held_out.groupBy("hash_key").count().where("count > 1").count() == 0


def test_op3_on_a_table(spark, tmp_path):
    """The registered query: rules as in brute force, judged verdicts those of the operator, long URLs whole."""
    urls = URLS + [f"http://h{k}.net/p/{k}?x={k}" for k in range(40)] + [f"http://h{k}.org/p/{k}" for k in range(40)] + [f"http://h{k}.com/de/{k}" for k in range(40)] + ["http://x.com/de/" + "a" * 100000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' as html").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in url_filter.op3(spark, str(tmp_path)).collect()}
    again = {r["page_id"]: r for r in url_filter.op3(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls) and got == again
    for k, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule) and verdict in (None, got[k]["verdict"])


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/"), (2, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(one).collect()] == ["allow"] * 3


# --- op 4


@pytest.mark.parametrize("unit", [4096, 40])
def test_mtree_is_exact(spark, monkeypatch, unit):
    monkeypatch.setattr(mtree, "UNIT", unit)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    x = (centres[rng.integers(0, 6, 400)] + 0.3 * rng.normal(size=(400, 12))).astype(np.float32)
    x[50:120] = x[50]  # many copies of one vector
    rows = [(k, [float(v) for v in x[k]]) for k in range(400)]
    odd = [(400, None), (450, [float("nan")] * 12), (500, [float("inf")] + [0.0] * 11), (550, [1.0, None]), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (None, [0.0] * 12), (650, [0.0] * 12), (700, []), (100, [0.5] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as unit", "'c' as cell")
    vectors = storage.stored(mtree.quantised(df), "test")
    got = {}
    for r in mtree.Index(vectors).search(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "q")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    table = [(k, [int(np.floor(256 * np.float64(np.float32(v)))) for v in e]) for k, e in rows + odd if k is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)]
    want = {}
    for k, q in table:
        if k % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in table if j != k and len(e) == len(q))[:5]
            want.setdefault(k, []).extend((n + 1, j, -s) for n, (s, j) in enumerate(found))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_mtree_prunes():
    rng = np.random.default_rng(0)
    centres = 500 * rng.normal(size=(40, 8))
    points = np.round(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))).astype(np.int64)
    tree, computed = mtree.Tree(points), []
    scores = tree.scores
    tree.scores = lambda own, q: computed.append(len(own)) or scores(own, q)
    found = tree.search(points[7], [[k] for k in range(4000)], 7, 5, None)
    exact = sorted(((-int(p @ points[7]), k) for k, p in enumerate(points) if k != 7))[:5]
    assert found == [(-s, k) for s, k in exact] and sum(computed) < 1000


def test_mtree_empty(spark):
    none = storage.stored(mtree.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>")), "test")
    assert mtree.Index(none).search(none.select(F.col("vec_id").alias("query_id"), "q")).count() == 0


# --- op 7


def test_warc_round_trip(spark):
    html = "<p>" + "long text " * 3000
    rows = [(k, f"http://x.org/{k}", f"<p>{k % 7}" if k % 3 else html) for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x/\r\nInjected: yes é", "🙂\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>1"), (103, "u", "same"), (103, "u", "same"), (103, "u", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as digest", "'c' as _block", "1 as refers_to")
    folder = storage.new_folder(spark, "test")
    manifest = warc.write(df, folder, 3, roll_bytes=2000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(manifest, folder, 2).collect()
    first = {}
    for k, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((h or "").encode(), k)
    want, have = [], []
    for k, _, h in rows:
        p = (h or "").encode()
        refers = None if first.get(p) == k else first.get(p)
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers, None if refers is not None else p))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    key = lambda r: [str(x) for x in r]
    assert sorted(have, key=key) == sorted(want, key=key)
    again = warc.write(df.repartition(5), other := storage.new_folder(spark, "test"), 3, roll_bytes=2000)
    names = lambda m: sorted((r["file"], r["sha256"]) for r in m.collect())
    assert names(manifest) == names(again) and other != folder  # the same bytes whatever the partitions
    large = warc.read(warc.write(df, f2 := storage.new_folder(spark, "test"), 1, min_bytes=100), f2, 1)
    assert large.where("record_type = 'revisit' and payload_bytes < 100").count() == 0


def test_warc_damage_is_seen(spark):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = storage.new_folder(spark, "test")
    manifest = warc.write(df, folder, 1)
    path = f"{folder.removeprefix('file://')}/{manifest.first()['file']}"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-9])
    with pytest.raises(Exception, match="ends inside|not what the manifest"):
        warc.read(manifest, folder, 1).collect()
    assert warc.read(warc.write(df.limit(0), f2 := storage.new_folder(spark, "t"), 2), f2, 1).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage on a small table: what it must drop goes, what is clean stays."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    from tests.llm.test_text_operators import toxic_docs

    rows, labels = toxic_docs(1500)
    rows = [(k, f"{t} unique{k} word{k * 7} more{k * 13} and{k * 3} yet{k * 5} again{k * 11} stop{k * 17}", "en", f"src{k % 4}", 1) for k, t, *_ in rows]
    long = " ".join(f"lorem{k} ipsum{k % 50}" for k in range(200))
    rows += [(5000, long, "en", "src0", 1), (5001, long, "en", "src1", 1), (5002, long.replace("lorem100", "changed"), "en", "src1", 1), (5003, "token=abcdef123456 plain text here to stay", "en", "src1", 1), (5004, None, None, None, None), (5005, "", "en", "src2", 0)]
    spark.createDataFrame(rows, H.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by_name, kept = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = storage.stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rs} for n, rs in kept.items()}
    toxic = {k for k, _, t in labels if t}
    assert len(ids["toxicity"] & toxic) < 0.05 * len(toxic) and len(ids["toxicity"] - toxic) > 0.97 * (len(rows) - len(toxic))
    assert ids["near_dedup"] & {5000, 5001, 5002} == {5000} and len(kept["toxicity"]) - len(kept["near_dedup"]) <= 4
    assert ids["secret_scan"] == ids["near_dedup"] and next(r["text"] for r in kept["secret_scan"] if r["doc_id"] == 5003).startswith("[SECRET] plain")
    assert ids["mixing"] <= ids["secret_scan"]
    pieces = by_name["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0 and {r["doc_id"] for r in pieces} == ids["mixing"]
    n = {}
    for r in kept["mixing"]:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert max(n.values()) <= 2


def test_registered_queries():
    found = queries.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(found)
