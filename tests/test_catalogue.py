import os
from collections import Counter

import duckdb
import pytest

from codeloom import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def test_every_query_has_its_twin():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    r = con.execute(catalogue.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == names
    want = Counter(tuple(x[cols.index(c)] for c in names) for x in r.fetchall())
    assert got == want
