import duckdb
import pytest

import __spark_entry__ as job
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(job.queries()))
def test_query_equals_sql(spark, database, name):
    df = job.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert rows
    sql = job.oracle_sql().get(name)
    if sql is None:
        return
    want = database.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    expected = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_every_sql_has_a_query():
    assert set(job.oracle_sql()) <= set(job.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    df = job.entry(spark)
    assert df.columns == ["k", "j", "v"] and df.count() == 8 * 200
