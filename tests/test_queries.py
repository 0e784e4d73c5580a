"""Every query runs, and gives the rows of its SQL where it has any."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from fieldmark.plans import papers, reports  # noqa: F401
from fieldmark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect()) if name in ORACLE_SQL else df.count()
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        want = Counter(tuple(value(r[names.index(c)]) for c in columns) for r in cur.fetchall())
        assert got == want
