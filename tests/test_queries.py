"""Every query with SQL against DuckDB on the test tables."""

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    names = frame.columns
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{n}{chr(34)}' for n in names)} FROM ({registry.ORACLES[name]})").fetchall()
    rows = lambda x: sorted(str(tuple(map(norm, r))) for r in x)
    assert rows(frame.collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
