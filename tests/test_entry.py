"""Registered queries against their SQL, and the entry points without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"

from tidalspan.plans import catalog  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events labels".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _sorted(found):
    return sorted(found, key=lambda r: [str(round(v, 3) if isinstance(v, float) else v) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in names) for r in df.collect())
    result = oracle.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    want = _sorted(tuple(r[columns.index(c)] for c in names) for r in result.fetchall())
    assert sorted(columns) == names and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6) if all(isinstance(v, float) for v in a) else a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-6) for x, y in zip(a, b, strict=True))


def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tidalspan", tmp_path / "tidalspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.stdout.strip() == "fine", run.stderr
