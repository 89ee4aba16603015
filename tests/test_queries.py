"""Every registered query against its check SQL, row by row."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from personaloom.registry.oracles import ORACLES
from personaloom.registry.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
# Plans that would not hold at scale.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "PythonRDD")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([row[i] for i in places] for row in rows), key=lambda row: [repr(v) for v in row])


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_check_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]
    got = ordered(df.columns, df.collect())
    result = db.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == ordered(names, result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
