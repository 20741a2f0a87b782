"""Actions of expressions against a plain walk over each tree."""

import random

from pyspark.sql import functions as F

from graphloom.operators import actions
from graphloom.operators.fixpoint import keep

SCHEMA = "node string, expr string, parent string, pos int, kind string, name string"
ARITY = {"name": 0, "inner": 1, "array": 2, "assign": 2, "assign_op": 2, "pre": 1, "post": 1, "choice": 3, "logic": 2, "plus": 2, "call": 3, "literal": 0}


def grow(rng, node, rows, parent, pos, depth, kinds):
    kind = rng.choice(kinds) if depth else "name"
    me = f"{node}-{sum(r[0] == node for r in rows)}"
    rows.append((node, me, parent, pos, kind, rng.choice("abc") if kind in ("name", "declare", "foreach", "parameter") else None))
    for k in range(1, (rng.randint(0, 1) if kind in ("declare", "return") else 1 if kind in ("foreach", "throw") else ARITY.get(kind, 0)) + 1):
        target = kind in ("assign", "assign_op", "pre", "post") and k == 1
        grow(rng, node, rows, me, k, depth - 1, ["name", "array", "inner"] if target or kind == "inner" else list(ARITY))


def plain(rows):
    kids = {}
    for node, expr, parent, pos, kind, name in rows:
        kids.setdefault(parent or node, []).append((pos, expr, kind, name))
    out = set()

    def walk(e, op, optional, say):
        _, me, kind, name = e
        c = [None, *sorted(kids.get(me, []))]
        go = lambda i, how="USE", maybe=False: walk(c[i], how, optional or maybe, say)
        match kind:
            case "name":
                say(name, op, optional)
            case "inner":
                go(1, op)
            case "array":
                go(1, op), go(2)
            case "assign":
                go(2), go(1, "DEF")
            case "assign_op":
                go(2), go(1), go(1, "DEF")
            case "pre":
                go(1), go(1, "DEF"), go(1)
            case "post":
                go(1), go(1, "DEF")
            case "choice":
                go(1), go(2, maybe=True), go(3, maybe=True)
            case "logic":
                go(1), go(2, maybe=True)
            case "declare":
                say(name, "DEC", False)
                if len(c) > 1:
                    go(1), say(name, "DEF", False)
            case "foreach":
                go(1), say(name, "DEC", False), say(name, "DEF", False)
            case "parameter":
                say(name, "DEC", False), say(name, "DEF", False)
            case "return" | "throw":
                if len(c) > 1:
                    go(1), say(actions.OUTPUT if kind == "return" else actions.EXCEPTION, "DEF", False)
            case _:
                for i in range(1, len(c)):
                    go(i)

    for node in {r[0] for r in rows}:
        did = []
        for e in sorted(kids[node]):
            walk(e, "USE", False, lambda *x: did.append(x))
        out |= {(node, *x, i) for i, x in enumerate(did, 1)}
    return out


def test_random_expressions(spark):
    rng, rows = random.Random(5), []
    for n in range(150):
        for pos in range(1, rng.randint(1, 3) + 1):
            grow(rng, f"n{n}", rows, None, pos, rng.randint(1, 5), [*ARITY, "declare", "foreach", "parameter", "return", "throw"])
    got = actions.expression_actions(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = plain(rows)
    assert len(got) == len(want) > 500
    assert {(r.node, r.var, r.op, r.optional, r.pos) for r in got} == want


def test_no_expressions(spark):
    assert actions.expression_actions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_a_node_are_moved_once(spark):
    rows = [("n", "1", None, 1, "assign", None), ("n", "2", "1", 1, "name", "a"), ("n", "3", "1", 2, "field", "f"), ("n", "4", "3", 1, "this", None), (None, "5", None, 1, "return", None), (None, "6", "5", 1, "name", "b")]
    was = spark.conf.get("spark.sql.adaptive.enabled")
    got = actions.expression_actions(spark.createDataFrame(rows, SCHEMA))
    # All rounds and the numbering read what lies by node already.
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.enabled") == was
    assert sorted((r.node or "", r.var, r.op, r.pos) for r in got.collect()) == [("", "-output-", "DEF", 2), ("", "b", "USE", 1), ("n", "a", "DEF", 2), ("n", "this.f", "USE", 1)]


def test_rounds_broadcast_nothing_of_themselves(spark, tmp_path):
    # A small file of which explode makes many rows: what joins guess from it says nothing of them.
    spark.range(3).write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t")).select(F.col("id").cast("string").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("expr"))
    a, b = (keep(many.repartition("node")) for _ in range(2))
    joined, hinted = a.join(b, ["node", "expr"]), a.join(F.broadcast(b), ["node", "expr"])
    assert keep(joined).count() == keep(hinted).count() == 27
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "BroadcastHashJoin" in hinted._jdf.queryExecution().executedPlan().toString()
