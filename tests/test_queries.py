"""Every query of the domain against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def database():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        yield c


DOMAIN = [n for n in entry.domain.QUERIES]


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", DOMAIN)
def test_query(spark, database, name):
    found = entry.queries()[name](spark, FOLDER).toPandas()
    if name not in entry.oracle_sql():
        assert len(found)
        return
    expected = database.execute(entry.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    key = [c for c in columns if found[c].dtype != float] + [c for c in columns if found[c].dtype == float]
    found, expected = (x[columns].sort_values(key, ignore_index=True) for x in (found, expected))
    assert len(found) == len(expected)
    for c in columns:
        same = (found[c] == expected[c]) | (found[c].isna() & expected[c].isna())
        assert same.all(), (c, found[c][~same].head(), expected[c][~same].head())
