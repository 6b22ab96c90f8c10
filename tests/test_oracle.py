"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from covey.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(frame):
    names = sorted(frame.columns)
    out = []
    for row in frame[names].itertuples(index=False):
        out.append(tuple("null" if v is None or v != v or str(v) in ("NaT", "<NA>") else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v) for v in (x.item() if hasattr(x, "item") else x for x in row)))
    return names, sorted(out)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    (names, rows), (want_names, want) = canonical(got), canonical(duck.sql(registry.SQL[name]).df())
    assert names == want_names
    assert rows == want
