"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from lithic.plans import catalog

catalog.load_all()
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def show(v):
    if isinstance(v, float) and not math.isnan(v):
        return f"{v:.6g}"
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE:
        assert rows is not None
        return
    want = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(show(r[i]) for i in at) for r in want.fetchall())
