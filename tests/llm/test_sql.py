"""The queries of this subpackage against their SQL, over whole tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from covey.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    out = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    rows = lambda table, names: Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in table)
    assert rows(out.collect(), out.columns) == rows(want.fetchall(), want.columns)
