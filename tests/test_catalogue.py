"""Every catalogue query against its SQL in DuckDB on the smallest tables; plans without Python."""

import os

import pytest

import __spark_entry__
from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted((tuple(map(rounded, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert ordered(df.collect()) == ordered([tuple(r[i] for i in at) for r in found.fetchall()])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op_not_in", "op_not_in_empty", "op_not_in_null"])
def test_not_in_is_an_equi_join(spark, name):
    plan = catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_theta_join_meets_by_price_band(spark):
    # the tables here are small enough to be broadcast, which would compare all parts of a brand in the few tasks that read them
    plan = catalogue.queries()["op_join_theta"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(keys) == 1 and "__band" in keys[0] and "p_brand" in keys[0] and "Broadcast" not in plan
    assert "p_name" not in plan


def test_numbering_looks_into_an_array(spark):
    plan = catalogue.queries()["op_zip_with_index"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "map" not in plan.lower().replace("mapobjects", "")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["n_name", "o_orderpriority", "revenue"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
