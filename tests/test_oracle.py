"""Every registered query against its SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from blockcat import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(rows):
    def value(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v

    return sorted(([value(v) for v in r] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = [[dict(zip(names, r, strict=True))[c] for c in cols] for r in want.fetchall()]
    assert same([[r[c] for c in cols] for r in got.collect()]) == same(rows)


def test_queries_without_sql_run(spark, sf_dir):
    for name in registry.QUERIES.keys() - registry.ORACLE.keys():
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
