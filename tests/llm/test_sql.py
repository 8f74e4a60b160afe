"""The operators' queries against their SQL, on whole tables."""

import duckdb
import pytest

from loomstar.llm import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))
