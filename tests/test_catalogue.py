"""Every query that has an oracle against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from inkwell.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    con.execute("SET timezone='UTC'")
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
