"""Every registered query against its SQL on DuckDB, over the smallest tables; the others have to run and give rows."""

import math
import os
import re

import duckdb
import pytest

from lodestream.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"w23_avalanches", "w17_cusum"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    yield con
    con.close()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    assert len(got) or name in MAY_BE_EMPTY
    want = duck.execute(registry.SQL[name]).df()
    a, b = rows(got), rows(want)
    assert a[0] == b[0]
    number = lambda x: repr(float(x)) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?", x) else x
    assert [tuple(map(number, r)) for r in a[1]] == [tuple(map(number, r)) for r in b[1]]
