"""The operators' queries against their SQL on the smallest tables."""

import duckdb
import pytest

from inkwell.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.ORACLES[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in cursor.fetchall())


def test_every_operator_has_a_query():
    assert [int(n.split("_")[0][2:]) for n in registry.QUERIES if n.startswith("op")] == list(range(1, 14))
