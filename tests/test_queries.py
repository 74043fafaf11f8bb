"""Every registered query against its SQL in DuckDB, value by value."""

import math

import duckdb
import pytest

from quillspark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in place) for r in cur.fetchall()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    assert all(_same(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["paper_id", "dry_score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
