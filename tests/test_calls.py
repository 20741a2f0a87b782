"""Call actions, field chains, insertion points and type templates against plain walks."""

import random

from graphloom.operators import actions, templates

SCHEMA = "node string, expr string, parent string, pos int, kind string, name string"
CALLS = "expr string, form string, returns boolean, alone boolean, params array<string>"


def grow(rng, node, rows, calls, parent, pos, depth):
    kind = rng.choice(["name", "this", "field", "field", "call", "call", "plus", "array", "inner", "logic"]) if depth else rng.choice(["name", "this"])
    me = f"{node}-{sum(r[0] == node for r in rows)}"
    rows.append((node, me, parent, pos, kind, rng.choice("abc") if kind in ("name", "field") else None))
    if kind == "call":
        form = rng.choice(["method", "static", "new", "construct"])
        if rng.random() < 0.5 and form in ("method", "new"):
            grow(rng, node, rows, calls, me, 0, depth - 1)
        n = rng.randint(0, 3)
        for k in range(1, n + 1):
            grow(rng, node, rows, calls, me, k, depth - 1)
        if rng.random() < 0.7:
            calls[me] = (form, rng.random() < 0.6, parent is None and rng.random() < 0.5, [f"p{k}" for k in range(1, max(1, n - 1) + 1)])
    for k in range(1, {"field": 1, "inner": 1, "plus": 2, "array": 2, "logic": 2}.get(kind, 0) + 1):
        grow(rng, node, rows, calls, me, k, depth - 1)


def plain(rows, calls):
    kids = {}
    for node, expr, parent, pos, kind, name in rows:
        kids.setdefault(parent or node, []).append((pos, expr, kind, name))

    def chain(e):
        _, me, kind, name = e
        if kind in ("name", "this"):
            return name if kind == "name" else "this"
        if kind not in ("field", "inner"):
            return None
        inner = chain(kids[me][0])
        return inner and (f"{inner}.{name}" if kind == "field" else inner)

    def walk(e, optional, real, say):
        _, me, kind, name = e
        c = sorted(kids.get(me, []))
        if kind == "name" or kind == "this":
            say(real, name if kind == "name" else "this", "USE", optional)
        elif kind == "field" and chain(e):
            say(real, chain(e), "USE", optional)
        elif kind == "call" and me in calls:
            form, returns, alone, params = calls[me]
            say(None, me, "ENTER", False)
            if form == "construct":
                say(real, "this", "DEC", False)
            scope = [x for x in c if x[0] == 0]
            for x in scope:
                walk(x, optional, f"{me}:this", say)
            if form == "method":
                if not scope:
                    say(f"{me}:this", "this", "USE", optional)
                say(f"{me}:this", "-scope-in-", "DEF", False)
            for x in c:
                if x[0]:
                    param = f"{me}:{params[min(x[0], len(params)) - 1]}"
                    walk(x, optional, param, say)
                    say(param, "-arg-in-", "DEF", False)
            if returns:
                say(f"{me}:return", "-output-", "DEF", False)
                if not alone:
                    say(None, "-output-", "USE", False)
            say(None, me, "EXIT", False)
            if form == "construct":
                say(real, "this", "DEF", False)
        else:
            for i, x in enumerate(c):
                walk(x, optional or (kind == "logic" and i == 1), real, say)

    out = {}
    for node in {r[0] for r in rows}:
        did = out[node] = []
        for e in sorted(kids[node]):
            walk(e, False, None, lambda *x: did.append(x))
    return out


def made(spark, n=120, seed=3):
    rng, rows, calls = random.Random(seed), [], {}
    for k in range(n):
        for pos in range(1, rng.randint(1, 2) + 1):
            grow(rng, f"n{k}", rows, calls, None, pos, rng.randint(1, 5))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return rows, calls, df, spark.createDataFrame([(e, *c) for e, c in calls.items()], CALLS)


def by_node(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.node, r.pos)):
        out.setdefault(r.node, []).append((r.real, r.var, r.op, r.optional))
        assert r.pos == len(out[r.node])
    return out


def test_random_calls(spark):
    rows, calls, df, table = made(spark)
    want = {n: did for n, did in plain(rows, calls).items() if did}
    acted = actions.call_actions(df, table).cache()
    assert by_node(acted) == want and sum(map(len, want.values())) > 800
    # Nodes of calls: each mark's call under its statement, ends under their calls.
    nodes = {tuple(r) for r in actions.call_nodes(acted).collect()}
    assert {n for n, _, k in nodes if k == "CALL"} == {v for did in want.values() for _, v, op, _ in did if op == "ENTER"}
    assert {(n, p) for n, p, k in nodes if k != "CALL"} == {(real, real.rsplit(":", 1)[0]) for did in want.values() for real, *_ in did if real}
    # Without a table of calls the walk is the plain one.
    assert {(r.node, r.var, r.op, r.optional, r.pos) for r in actions.expression_actions(df).collect()} == {(n, *x[1:], i) for n, did in plain(rows, {}).items() for i, x in enumerate(did, 1)}


def test_insertion_points(spark):
    rows, calls, df, table = made(spark, 60, 8)
    acted = actions.call_actions(df, table).cache()
    rng = random.Random(1)
    lists = {n: list(did) for n, did in plain(rows, calls).items() if did}
    added = [(c, rng.random() < 0.5, k, f"{c}:new", f"v{k}", "DEF", False) for c in list(calls)[::2] for k in range(rng.randint(1, 3))]
    want = {}
    for n, did in lists.items():
        new = []
        for x in did:
            here = [(real, v, op, o) for c, pre, _, real, v, op, o in sorted(added, key=lambda a: a[2]) if c == x[1] and x[2] == ("ENTER" if pre else "EXIT")]
            new += [x, *here] if x[2] == "ENTER" else [*here, x]
        want[n] = new
    schema = "call string, prepend boolean, ord int, real string, var string, op string, optional boolean"
    assert by_node(actions.insert_for_calls(acted, spark.createDataFrame(added, schema))) == want
    # After the first run of a node's actions, or after ENTER.
    later = [(c, 0, rng.choice([f"{c}:p1", f"{c}:this", f"{c}:none"]), "w", "USE", False) for c in list(calls)[::3]]
    want = {}
    for n, did in lists.items():
        new = list(did)
        for c, _, real, v, op, o in later:
            at = [i for i, x in enumerate(new) if x[0] == real]
            enter = [i for i, x in enumerate(new) if x[2] == "ENTER" and x[1] == c]
            if enter:
                i = enter[0]
                if at:
                    i = at[0]
                    while i + 1 < len(new) and new[i + 1][0] == real:
                        i += 1
                new.insert(i + 1, (real, v, op, o))
        want[n] = new
    assert by_node(actions.insert_after_real(acted, spark.createDataFrame(later, "call string, ord int, real string, var string, op string, optional boolean"))) == want


def test_calls_on_the_way(spark, monkeypatch):
    """Rows that lie by statement are neither moved nor written, and what is inserted on the way is what is inserted later."""
    rows, calls, df, table = made(spark, 60, 8)
    acted = actions.call_actions(df, table).cache()
    added = [(c, pre, k, f"{c}:new", f"v{k}", "DEF", False) for c in [*calls][::2] for pre in (True, False) for k in range(2)]
    added = spark.createDataFrame([*added, ("absent", True, 0, "r", "v", "DEF", False)], "call string, prepend boolean, ord int, real string, var string, op string, optional boolean")
    want = by_node(actions.insert_for_calls(acted, added))
    assert by_node(actions.call_actions(df, table, added)) == want
    held = df.select("node", "expr")
    lying = [x.repartition(4, "node") for x in (df, table.join(held, "expr"), added.join(held.withColumnRenamed("expr", "call"), "call"))]
    was = actions.keep
    monkeypatch.setattr(actions, "keep", None)
    got = actions.call_actions(*lying)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(node") == 3 and "hashpartitioning(proc" not in plan
    assert by_node(got) == want
    # Without calls rows are written once, and statements with null keys and positions are walked too.
    monkeypatch.setattr(actions, "keep", was)
    odd = [(None, "1", None, None, "declare", "x"), (None, "2", "1", 1, "name", "y"), ("n", None, None, 1, "name", "z"), ("n", "3", None, 2, None, None), ("n", "4", "3", None, "name", "w")]
    assert {(r.node, r.var, r.op, r.pos) for r in actions.expression_actions(spark.createDataFrame(odd, SCHEMA)).collect()} == {(None, "x", "DEC", 1), (None, "y", "USE", 2), (None, "x", "DEF", 3), ("n", "z", "USE", 1), ("n", "w", "USE", 2)}


def test_nodes_of_calls_read_actions_once(spark):
    _, _, df, table = made(spark, 5)
    assert actions.call_nodes(actions.call_actions(df, table))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_chains_and_empty_tables(spark):
    rows = [("n", "1", None, 1, "field", "c"), ("n", "2", "1", 1, "inner", None), ("n", "3", "2", 1, "field", "b"), ("n", "4", "3", 1, "this", None), ("m", "5", None, 1, "field", "x"), ("m", "6", "5", 1, "array", None), ("m", "7", "6", 1, "name", "a"), ("m", "8", "6", 2, "name", "i")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in actions.field_chains(df).collect()} == {("1", "this.b.c"), ("3", "this.b")}
    got = {(r.node, r.var, r.pos) for r in actions.expression_actions(df).collect()}
    assert got == {("n", "this.b.c", 1), ("m", "a", 1), ("m", "i", 2)}
    assert actions.call_actions(df.limit(0), spark.createDataFrame([], CALLS)).count() == 0
    assert actions.field_chains(df.limit(0)).count() == 0


def test_type_templates(spark):
    rng = random.Random(5)
    types = [f"T{i}" for i in range(6)]
    fields = {t: {f"f{k}": rng.choice([*types, None]) for k in range(rng.randint(0, 2))} for t in types}
    fields["T0"]["self"] = "T0"
    subs = {t: {t} | {s for s in types if rng.random() < 0.15} for t in types}

    def tree(t, depth):
        if depth >= 4:
            return
        for s in subs[t]:
            if fields[s]:
                yield (f"<{s}>",)
                for name, held in fields[s].items():
                    yield (f"<{s}>", name)
                    for rest in tree(held, depth + 1) if held else ():
                        yield (f"<{s}>", name, *rest)

    field_rows = spark.createDataFrame([(t, n, h) for t, fs in fields.items() for n, h in fs.items()] + [(None, "x", None)], "type string, name string, field_type string")
    sub_rows = spark.createDataFrame([(t, s) for t, ss in subs.items() for s in ss], "type string, subtype string")
    got = templates.type_templates(field_rows, sub_rows, 4).cache()
    want = {(t, p) for t in types for p in tree(t, 0)}
    assert {(r.type, tuple(r.path)) for r in got.collect()} == want and len(want) > 50
    assert got.count() == len(want)
    asked = [("T0", ["self", "self"]), ("T0", ["self"]), ("T0", ["no"]), ("T0", ["<T0>", "self"])]
    found = templates.lookup(got, spark.createDataFrame(asked, "type string, path array<string>"))
    flat = lambda p: [x for x in p if x[0] != "<"]
    assert {(r.type, tuple(r.wanted), tuple(r.path)) for r in found.collect()} == {(t, tuple(w), p) for t, w in asked for s, p in want if s == t and flat(p) == flat(w) and p[-1][0] != "<"}
    assert templates.type_templates(field_rows.limit(0), sub_rows, 4).count() == 0
