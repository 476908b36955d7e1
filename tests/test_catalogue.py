import glob
import os
import subprocess
import sys

import duckdb
import pytest

from tilewright.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = db.sql(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert rows(got).equals(rows(want))


def test_entry_works_without_the_llm_folders(tmp_path):
    for x in os.listdir(ROOT):
        if x not in (".git", "corpus_pipeline.py", "tests"):
            os.symlink(f"{ROOT}/{x}", tmp_path / x) if x != "tilewright" else None
    os.mkdir(tmp_path / "tilewright")
    for x in os.listdir(f"{ROOT}/tilewright"):
        if x not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/tilewright/{x}", tmp_path / "tilewright" / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'range_query' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
