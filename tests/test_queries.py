"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("LUMBUNG_TEST_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
