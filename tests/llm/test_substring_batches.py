"""A kept index: named batches, failures, empty and tiny batches."""

import os
import shutil

import pytest

from tests.llm import helpers as H
from tidalspan.llm import substring


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_runs_once_under_its_name(spark, tmp_path):
    rows = H.texts()[:40]
    folder, (a, b) = f"file://{tmp_path}/index", (rows[:20], rows[20:])
    whole = rows_of(substring.dedupe(H.docs(spark, rows), 3, 5))
    first = rows_of(substring.dedupe(H.docs(spark, a), 3, 5, folder, batch="a"))
    second = rows_of(substring.dedupe(H.docs(spark, b), 3, 5, folder, batch="b"))
    assert sorted(first + second) == whole
    assert rows_of(substring.dedupe(H.docs(spark, b), 3, 5, folder, batch="b")) == second
    assert rows_of(substring.dedupe(H.docs(spark, a), 3, 5, folder, batch="a")) == first


@pytest.mark.parametrize("lost", ["run-00000001-2-b", "result-b", "done-b"])
def test_a_batch_that_failed_can_be_run_again(spark, tmp_path, lost):
    """Whatever was written before the failure: the answer is that of one whole run."""
    rows = H.texts()[:40]
    folder = f"file://{tmp_path}/index"
    substring.dedupe(H.docs(spark, rows[:20]), 4, 5, folder, batch="a").collect()
    want = rows_of(substring.dedupe(H.docs(spark, rows[20:]), 4, 5, folder, batch="b"))
    after = ["result-b", "run-00000001-2-b", "done-b"]  # the order in which they are written
    for name in after[after.index(lost) :]:
        shutil.rmtree(f"{tmp_path}/index/{name}")
    assert rows_of(substring.dedupe(H.docs(spark, rows[20:]), 4, 5, folder, batch="b")) == want
    again = rows_of(substring.dedupe(H.docs(spark, [(9000 + r[0], *r[1:]) for r in rows]), 4, 5, folder, batch="c"))
    assert all(r[2] == (r[1] if r[1] >= 5 else 0) for r in again)  # all windows are known by now


def test_batches_with_few_windows(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(20))
    folder = f"file://{tmp_path}/index"
    assert substring.dedupe(H.empty(spark), 16, 20, folder, batch="none").count() == 0
    got = [substring.dedupe(H.docs(spark, [(k, text, "en", "s", 1)]), 16, 20, folder).first()["n_removed"] for k in range(6)]
    assert got == [0, 20, 20, 20, 20, 20]
    assert len([n for n in os.listdir(f"{tmp_path}/index") if n.startswith("run-")]) < substring.FANOUT
    with pytest.raises(ValueError, match="letters"):
        substring.dedupe(H.empty(spark), 16, 20, folder, batch="a-b")


def test_rows_of_one_id_fill_several_blocks(spark):
    """A third of the rows have no id; the order among them is that of the texts' hashes."""
    import hashlib

    from tests.llm.test_ranges import tie

    rows = [(None if k % 3 == 0 else k, t, *rest) for k, t, *rest in H.texts()]
    seen, want = set(), []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        w = H.words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 4):
            key = tuple(w[k : k + 5])
            if key in seen:
                gone[k : k + 5] = [True] * 5
            seen.add(key)
        want.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    for blocks in (1, 9):
        got = [tuple(r) for r in substring.dedupe(H.docs(spark, rows), blocks, 5).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
