"""Every registered query with SQL gives what DuckDB gives; the others run."""

import math

import duckdb
import pytest

from channelweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 5)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, found.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_atoms_add_up(spark, sf_dir):
    for name in ("broja_atoms", "ccs_atoms"):
        for r in catalogue.QUERIES[name](spark, sf_dir).collect():
            assert r.converged and abs(r.red + r.u_val + r.u_str + r.syn - r.i_joint) < 1e-6


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["user_id", "event_type", "value_first", "time_first", "value_last", "time_last"]
