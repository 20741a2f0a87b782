"""Every query of the graph library against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from graphloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_reach_ends_on_cycles(spark):
    from graphloom.operators.fixpoint import reach

    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "d"), (3, "x")], "key int, node string")
    got = {(r.key, r.node) for r in reach(seeds, arcs).collect()}
    assert got == {(1, x) for x in "abc"} | {(2, x) for x in "abcd"} | {(3, "x")}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_first_nodes_are_found_without_sorting_or_moving_rows(spark):
    plan = QUERIES["node_first"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort [" not in plan
