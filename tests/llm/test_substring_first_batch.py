"""An index that began with one short document."""

from tests.llm import helpers as H
from tidalspan.llm import substring


def test_small_first_batch_keeps_its_shards(spark, tmp_path):
    # one window, in the third of eight shards: the shards above it stay empty
    text = next(t for t in (f"a b c d w{k}" for k in range(1000)) if int(substring.Block([t], 5).h[0]) >> 61 == 2)
    folder, got = f"file://{tmp_path}/index", []
    for doc in (1, 2, 3):
        got += substring.dedupe(H.docs(spark, [(doc, text, "en", "s", 1)]), 8, 5, folder).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(1, 0), (2, 5), (3, 5)]
