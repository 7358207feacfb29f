"""Every registered query of the market library against its SQL on DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from staylens import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cells(row):
    return tuple("null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(cells(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in plans.SQL:
        wanted = duck.execute(plans.SQL[name])
        names = [d[0] for d in wanted.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(cells([r[i] for i in order]) for r in wanted.fetchall())
    else:
        assert rows
