"""Every registered query against its check SQL at the smallest scale."""

import pathlib

import duckdb
import pytest

from strandlab import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_names_match():
    assert set(catalog.CHECKS) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cur = con.execute(catalog.CHECKS[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == normal(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.CHECKS)))
def test_gives_rows(spark, name):
    assert not catalog.QUERIES[name](spark, FOLDER).isEmpty()
