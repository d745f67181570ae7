"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("STRANDLAKE_TEST_TABLES", "/root/testdata/sf0.001")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p1_", "p4_", "p5_", "p7_", "p8_", "p9_"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(map(normal, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    assert ours == Counter(repr(tuple(normal(r[i]) for i in at)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
