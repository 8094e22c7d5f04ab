from collections import Counter

import duckdb
import pytest

from codeloom.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    r = con.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    df = registry.QUERIES[name](spark, SMALL)
    assert sorted(cols) == sorted(df.columns)
    assert Counter(tuple(x[c] for c in cols) for x in df.collect()) == Counter(r.fetchall())
