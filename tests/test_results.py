"""Results, transfers and out-variables of expressions against plain recursion."""

import random

from graphloom.operators import results

SCHEMA = "node string, expr string, parent string, pos int, kind string, name string"
ARITY = {"name": 0, "this": 0, "inner": 1, "field": 1, "array": 2, "choice": 3, "assign": 2, "assign_op": 2, "plus": 2, "pre": 1, "call": 2, "literal": 0, "lambda": 1}


def grow(rng, rows, node, parent, pos, depth):
    kind = rng.choice(list(ARITY) if depth else ["name", "this", "literal"])
    me = f"{node}-{sum(r[0] == node for r in rows)}"
    rows.append((node, me, parent, pos, kind, rng.choice("abc") if kind in ("name", "field") else None))
    for k in range(1, ARITY[kind] + 1):
        grow(rng, rows, node, me, k, depth - 1)


def plain(rows, linked):
    kids = {}
    for node, expr, parent, pos, kind, name in rows:
        kids.setdefault(parent, []).append((pos, expr, kind, name))

    def value(e, path):
        _, me, kind, name = e
        c = [None, *sorted(kids.get(me, []))]
        match kind:
            case "name" | "this":
                return [(me, name or "this", path)]
            case "call":
                return [(me, "-output-", path)] if me in linked else []
            case "literal" | "lambda":
                return []
            case "field":
                return value(c[1], (name, *path))
            case "inner" | "array":
                return value(c[1], path)
            case "choice":
                return value(c[2], path) + value(c[3], path)
            case "assign" | "assign_op":
                return value(c[2], path)
        return [x for child in c[1:] for x in value(child, ())]

    def out(e):
        _, me, kind, name = e
        c = [None, *sorted(kids.get(me, []))]
        match kind:
            case "name" | "this":
                return [(me, name or "this")]
            case "field" | "inner" | "array":
                return out(c[1])
            case "choice":
                return out(c[2]) + out(c[3])
            case "assign" | "assign_op":
                return out(c[1]) + out(c[2])
        return []

    tops = kids[None]
    values = {(e[1], *x) for e in tops for x in value(e, ())}
    return values, {(e[1], *x, len(out(e)) > 1) for e in tops for x in out(e)}


def test_random_results(spark):
    rng, rows = random.Random(9), []
    for n in range(200):
        grow(rng, rows, f"n{n}", None, 1, rng.randint(0, 6))
    linked = {r[1] for r in rows if r[4] == "call" and rng.random() < 0.5}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    roots = df.where("parent is null").selectExpr("expr as root")
    values, outs = plain(rows, linked)
    found = results.result_trees(df, roots, spark.createDataFrame([(x,) for x in linked], "expr string")).cache()
    assert {(r.root, r.expr, r.var, tuple(r.path)) for r in found.collect()} == values and len(values) > 150
    assert {tuple(r) for r in results.out_variables(df, roots).collect()} == outs and any(o[-1] for o in outs)
    targets = roots.selectExpr("root", "root as target", "'m' as member", "case when root < 'n15' then root < 'n12' end as has_tree")
    for r in results.transfers(found, targets).collect():
        assert (r.kind, r.member) == (("TREE", "m") if r.target < "n12" else ("VALUE", None))
    assert results.result_trees(df.limit(0), roots, roots.selectExpr("root as expr")).count() == 0
    assert results.out_variables(df.limit(0), roots).count() == 0


def test_levels_move_no_rows_between_statements(spark):
    from graphloom.plans import bindings

    expressions, roots, linked = bindings.order_choices(spark, "/root/testdata/sf0.001")
    for df in (results.result_trees(expressions, roots, linked), results.out_variables(expressions, roots)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
