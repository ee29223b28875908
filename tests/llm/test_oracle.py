"""Registered queries against their SQL on whole tables."""

import duckdb
import pytest

from churnforge.llm.queries import ORACLE_SQL, REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[key])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in names]
    df = REGISTRY[key](spark, SF)
    assert sorted(df.columns) == names
    got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in REGISTRY] == [f"op{n}" for n in range(1, 14)]
