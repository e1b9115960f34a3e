"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import os

import duckdb
import numpy as np
import pytest

from quarryline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    def text(v):
        if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return "null"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6))
        if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
        return
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_answers_every_question(spark, con):
    want = {r[0] for r in con.execute("select id from escalations where question is not null").fetchall()}
    assert {r["question_id"] for r in registry.queries()["answers"](spark, SF).select("question_id").collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
