"""Repeated rows in the M-tree's entries."""

from tidalspan.llm import mtree


def test_repeats_of_the_query_hide_no_other_id(spark):
    same, other = [64, 128], [10, 10]
    rows = [(50, same)] * 7 + [(51, same), (52, same), (52, same)] + [(k, other) for k in range(60, 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, q array<long>")
    asked = spark.createDataFrame([(50, same), (60, other)], "query_id long, q array<long>")
    got = {}
    for r in mtree.Index(vectors).search(asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {i: [v for v, _ in sorted(((v, q) for v, q in rows if v != i), key=lambda r: (-score(r[1], a), r[0]))[:5]] for i, a in ((50, same), (60, other))}
    assert got == want
