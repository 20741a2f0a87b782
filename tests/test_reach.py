"""Rounds of a closure with much news."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import fixpoint
from graphloom.operators.fixpoint import reach


def plain(seeds, arcs):
    out = set(seeds)
    todo = list(out)
    while todo:
        key, node = todo.pop()
        for pair in {(key, y) for x, y in arcs if x == node} - out:
            out.add(pair)
            todo.append(pair)
    return out


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_rounds_of_any_size_find_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(fixpoint, "SMALL", limit)
    rng = random.Random(limit)
    arcs = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)] + [(20, 21), (21, 22), (22, 20)]
    seeds = [(k, rng.choice([0, 1, 2, 20])) for k in range(8)]
    pairs = lambda rows, names: spark.createDataFrame(rows, names)
    got = reach(pairs(seeds, "key long, node long"), pairs(arcs, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted(plain(seeds, arcs))
    known = pairs([(0, 21), (9, 9)], "key long, node long")
    more = reach(pairs([(0, 20)], "key long, node long"), pairs(arcs, "src long, dst long"), known)
    assert sorted(map(tuple, more.collect())) == [(0, 20), (0, 21), (9, 9)]


def test_news_at_nodes_without_keys_is_not_held_against_what_is_known(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "SMALL", 3)
    delta = spark.createDataFrame([(k, "hub") for k in range(50)], "key long, node string")
    arcs = spark.createDataFrame([("hub", "next"), ("far", "off")], "src string, dst string")
    unread = delta.withColumn("node", F.raise_error(F.lit("read")).cast("string"))
    found, met = fixpoint._far(delta, arcs, unread, spark.createDataFrame([("hub",)], "node string"))
    assert found.count() == 50 and {r.node for r in found.collect()} == {"next"}
    assert {r.node for r in met.collect()} == {"hub", "next"}
    assert fixpoint._far(found, arcs, unread, met)[0].isEmpty()


def test_large_rounds_move_their_news_alone(spark, monkeypatch):
    """Once a round brings much, arcs lie by source and what is known by key and node: a round's plan moves its news twice, and nothing else."""
    plans, was = [], fixpoint.keep

    def keep(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
        return was(df)

    monkeypatch.setattr(fixpoint, "keep", keep)
    monkeypatch.setattr(fixpoint, "SMALL", 3)
    arcs = [(f"a{i}", f"a{(i + 1) % 12}") for i in range(12)] + [(f"a{i}", f"a{(i * 5) % 12}") for i in range(12)]
    seeds = [(k, f"a{k}") for k in range(8)]
    got = {tuple(r) for r in fixpoint.reach(spark.createDataFrame(seeds, "key int, node string"), spark.createDataFrame(arcs, "src string, dst string")).collect()}
    want = set(seeds)
    while more := {(k, t) for k, n in want for s, t in arcs if s == n} - want:
        want |= more
    assert got == want
    held = [p for p in plans if "LeftAnti" in p]
    assert held
    assert all(p.count("Exchange hashpartitioning") <= 2 for p in plans)


def test_many_near_keys(spark, monkeypatch):
    """Keys that reach little: news meet the arcs at their nodes without being moved, and are moved once there and back where these are many."""
    plans, was = [], fixpoint.keep

    def keep(df):
        out = was(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(fixpoint, "keep", keep)
    rng = random.Random(4)
    arcs = [(f"a{i}", f"a{(i + 1) % 12}") for i in range(12)] + [(f"b{rng.randrange(40)}", f"b{rng.randrange(40)}") for _ in range(60)] + [("b1", "b1"), ("b1", "a3"), ("b2", None)]
    nodes = [f"{k}{i}" for k in "abc" for i in range(0, 40, 3)]
    want = {(n, n) for n in nodes}
    while more := {(k, t) for k, n in want for s, t in arcs if s == n} - want:
        want |= more
    for few in (fixpoint.FEW, 0):
        monkeypatch.setattr(fixpoint, "FEW", few)
        plans.clear()
        got = fixpoint.reach_near(spark.createDataFrame([(n,) for n in nodes * 2], "node string"), spark.createDataFrame(arcs * 2, "src string, dst string"))
        # Nothing is moved if arcs are few.
        rounds = [p for p in plans if "LeftAnti" in p]
        assert len(rounds) > 8 and max(p.count("Exchange hashpartitioning") for p in rounds) == (0 if few else 2)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len([r for r in rows if r[1]]) == len([r for r in want if r[1]])


def test_searches_from_null_variables_are_left_out(spark):
    rows = lambda data, names: spark.createDataFrame(data, names)
    starts = rows([(1, "k", "v", "a"), (1, "k", None, "a"), (1, None, "v", "a")], "proc long, key string, var string, node string")
    arcs = rows([(1, "a", "b"), (1, "b", "c")], "proc long, src string, dst string")
    walls = rows([(1, "b", "v")], "proc long, node string, var string")
    marks = rows([(1, "b", None), (1, "c", "v"), (1, "a", "w")], "proc long, node string, var string")
    assert [tuple(r) for r in fixpoint.search(starts, arcs, walls, marks).collect()] == [("k", "v", "b")]


def test_procedures_are_read_many_a_batch(spark):
    """One after another in a task's stream, each with rows of either side, not a frame each; numbers beside nulls stay whole."""
    big = 2**53 + 1
    nodes = spark.createDataFrame([(p, p * 10, None if p % 2 else big) for p in range(50)] + [(None, 7, 7)], "proc long, node long, mark long")
    arcs = spark.createDataFrame([(p, p * 10, p * 10 + k) for p in range(48) for k in (1, 2)] + [(99, 5, 6)], "proc long, src long, dst long")

    def visit(proc, left, successors):
        yield proc, left["mark"][0] if left["mark"] else -1, sum(len(x) for x in successors.values())

    df = fixpoint.per_procedure(nodes, arcs, "proc long, mark long, n int", visit)
    want = {(p, None if p % 2 else big, 2 if p < 48 else 0) for p in range(50)} | {(99, -1, 1), (None, 7, 0)}
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
