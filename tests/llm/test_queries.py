"""Every query of the subpackage that has SQL gives what DuckDB gives."""

import duckdb
import pytest

from channelweave.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


# the new operators' SQL is run by their own tests
@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op11_ranked_search", "op12_quality_rules", "op13_repair_conversations"}))
def test_same_as_sql(spark, duck, sf_dir, name):
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_all_operators_are_registered():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
