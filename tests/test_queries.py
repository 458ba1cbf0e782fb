"""Every registered query against its oracle in DuckDB, over the smallest tables; the others must give rows."""

import os

import duckdb
import pytest

from lithos.plans import registry

SF = os.environ.get("LITHOS_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(repr(tuple(None if x is None or x != x else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert cols == sorted(names)
    expected = [tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()]
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
