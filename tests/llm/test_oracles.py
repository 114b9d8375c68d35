import duckdb
import pytest

from quire.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    df = queries.queries()[name](spark, tiny)
    found = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(found.fetchall()) == sorted(map(tuple, df.collect()))
