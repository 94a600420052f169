"""Every registered query of the subpackage, and the pipeline, on odd and empty tables."""

import hashlib

import pytest

from tests.llm import helpers as H
from tidalspan.llm import queries

pytest.importorskip("public_tokenizers")

PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>"


def write(spark, folder, docs, pages, labels, vectors):
    """Tables with further columns of names that the operators use inside."""
    for name, rows, schema in (("documents", docs, H.SCHEMA), ("pages", pages, PAGES), ("labels", labels, LABELS), ("embeddings", vectors, VECTORS)):
        df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as node", "'x' as k", "'x' as _block", "1 as size", "'x' as _h", "2 as fingerprint", "'x' as verdict")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = H.texts()
    docs += [docs[3], docs[3], (None, docs[4][1], None, None, None), (7, "another text of the same id", "en", "src0", 1), (900, "ein Wort " * 30000, "de", "src1", None)]
    pages = [(k, f"http://h{k % 5}.{('org', 'com', 'net')[k % 3]}/{('fr', 'de')[k % 2]}/{k}", f"<p>{k % 9}") for k in range(60)]
    pages += [(None, None, None), (61, None, ""), (61, "", None), pages[0], pages[0], (62, "http://x.org/" + "y" * 50000, "z" * 100000)]
    labels = [(k, 0, int(k % 12 == 0)) for k in range(50)] + [(None, 1, 1), (3, 0, None), (4, 0, 1), (4, 0, 0), (7, 1, 1)]
    vectors = [(k, [float((k * j) % 7) / 7 for j in range(4)]) for k in range(120)] + [(None, [1.0] * 4), (3, None), (50, [0.5] * 4), (50, [0.5] * 4), (5, [None, 1.0, 1.0, 1.0]), (100, [])]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, pages, labels, vectors), len(docs), len(pages)


@pytest.mark.parametrize("name", [q for q in queries.queries() if not q.startswith(("op4_", "op8_"))])
def test_a_row_for_each_row(spark, odd, name):
    folder, docs, pages = odd
    got = queries.queries()[name](spark, folder).collect()
    assert len(got) == (pages if name.startswith(("op3_", "op7_")) else docs)
    again = queries.queries()[name](spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pieces_of_odd_tables(spark, odd):
    got = queries.queries()["op8_harmonic_packing"](spark, odd[0]).collect()
    assert sum(r["start"] == 0 for r in got) == odd[1] and all(r["length"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, write(spark, tmp_path, [], [], [], [])).count() == 0


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    text = {}
    for doc, t, *_ in [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd[0]}/documents.parquet").collect()]:
        text.setdefault(doc, set()).add(t)
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, odd[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    pieces = corpus_pipeline.run(spark, odd[0]).collect()
    assert pieces and all(r["length"] == len(r["ids"]) and r["doc_id"] in text for r in pieces)
    used = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048 and at.bit_count() == 1
    again = corpus_pipeline.run(spark, odd[0]).collect()
    key = lambda rows: sorted(hashlib.sha256(str((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"])).encode()).hexdigest() for r in rows if r["start"] == 0)
    assert len(key(again)) == len(key(pieces))
    none = write(spark, tmp_path / "none", [], [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
