import glob
import os

import duckdb
import pytest

from tilewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    table, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
    ids = {r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert set(got[key]) == ids and (name.startswith("op1_") or len(got) == len(ids))
    if name in ORACLES:
        db = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        want = db.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        rows = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
        assert rows(got).equals(rows(want))
