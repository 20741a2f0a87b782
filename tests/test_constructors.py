"""Control flow of constructors against a plain walk over random bodies; nodes of types by hand."""

import random

from graphloom.operators import constructors, hierarchy


def plain(proc, c, arcs, inits):
    """The same by steps on one graph: put nodes in behind one, turn loose ends to the added return."""
    arcs, implicit = set(arcs), {}
    for s, d, _ in arcs:
        implicit[s] = implicit[d] = c["implicit"]
    back = f"{proc}:return this"
    for s, d, k in sorted(arcs):
        returned = s in c["returns"] if k == "EXEC" else s == c["enter"]
        if d == c["exit"] and not returned:
            arcs.remove((s, d, k))
            arcs.add((s, back, k))
    arcs.add((back, c["exit"], "EXEC"))
    implicit[back] = True
    new = []
    at = c["enter"]
    if c["opens"] == "super":
        at = c["opening"]
    elif c["opens"] is None and not c["is_enum"]:
        new.append((f"{proc}:super", True))
    if c["opens"] != "this":
        new += [(f"{proc}:{n}", False) for _, n in sorted(inits)]
    for n, imp in new:
        out = {a for a in arcs if a[0] == at and a[2] == "EXEC"}
        arcs = (arcs - out) | {(n, d, k) for _, d, k in out} | {(at, n, "EXEC")}
        implicit[n], at = imp, n
    return arcs, implicit


def test_constructor_flow(spark):
    rng = random.Random(4)
    arcs, rows, want_arcs, want_nodes = [], [], set(), set()
    inits = {t: [(i, f"{t}f{i}") for i in range(rng.randint(0, 3))] for t in "ABCD"}
    for p in range(60):
        nodes = [f"{p}.{i}" for i in range(rng.randint(0, 6))]
        c = {"proc": str(p), "type": rng.choice("ABCD"), "enter": f"{p}.enter", "exit": f"{p}.exit", "is_enum": rng.random() < 0.3, "implicit": rng.random() < 0.3}
        c["opens"] = rng.choice([None, "this", "super"]) if nodes else None
        c["opening"] = nodes[0] if c["opens"] else None
        c["returns"] = [n for n in nodes[1:] if rng.random() < 0.3]
        line = [c["enter"], *nodes, c["exit"]]
        own = {(c["enter"], c["exit"], "NONEXEC")}
        for a, b in zip(line, line[1:], strict=False):
            own |= {(a, c["exit"], "EXEC"), (a, b, "NONEXEC")} if a in c["returns"] else {(a, b, "EXEC")}
            if a in nodes[1:] and a not in c["returns"] and rng.random() < 0.4:
                own.add((a, rng.choice(line[2:]), "EXEC"))
        got_arcs, implicit = plain(c["proc"], c, own, inits[c["type"]])
        want_arcs |= {(c["proc"], *a) for a in got_arcs}
        want_nodes |= {(c["proc"], n, i) for n, i in implicit.items()}
        arcs += [(c["proc"], *a) for a in own]
        rows.append(tuple(c.values()))
    table = spark.createDataFrame(rows, "proc string, type string, enter string, exit string, is_enum boolean, implicit boolean, opens string, opening string, returns array<string>")
    init = spark.createDataFrame([(t, i, n) for t, xs in inits.items() for i, n in xs], "type string, pos int, node string")
    flow, nodes = constructors.constructor_flow(spark.createDataFrame(arcs, "proc string, src string, dst string, kind string"), table, init)
    got = [tuple(r) for r in flow.collect()]
    assert set(got) == want_arcs and len(got) == len(want_arcs) > 300
    assert {tuple(r) for r in nodes.collect()} == want_nodes
    empty, none = constructors.constructor_flow(spark.createDataFrame([], "proc string, src string, dst string, kind string"), table.limit(0), init)
    assert empty.count() == none.count() == 0


def test_types(spark):
    types = spark.createDataFrame([("p.A", "A", "class"), ("p.E", "E", "enum"), ("p.I", "I", "interface")], "type string, name string, kind string")
    fields = spark.createDataFrame([("p.A", "x", True), ("p.A", "y", False), ("p.E", "z", True), ("gone", "w", True)], "type string, name string, static boolean")
    constants = spark.createDataFrame([("p.E", "ONE"), ("p.A", "NOT")], "type string, name string")
    nodes, arcs = constructors.type_nodes(types, fields, constants)
    assert {tuple(r) for r in nodes.collect()} == {("type:p.A", "class A", "A"), ("type:p.E", "enum E", "E"), ("type:p.I", "interface I", "I")}
    assert {tuple(r) for r in arcs.collect()} == {(f"type:p.{t}", f"tree:p.{t}") for t in "AEI"} | {("tree:p.A", "tree:p.A/x"), ("tree:p.E", "tree:p.E/z"), ("tree:p.E", "tree:p.E/ONE")}
    ctors = spark.createDataFrame([("c1", "p.A"), ("c2", "p.A")], "proc string, type string")
    assert {tuple(r) for r in hierarchy.implicit_constructors(types, ctors).collect()} == {("p.E", "new p.E")}
    calls = spark.createDataFrame([("k", "p.A", False), ("s", "p.A", True), ("e", "p.E", False)], "call string, type string, static boolean")
    assert {tuple(r) for r in constructors.initialiser_calls(calls, ctors).collect()} == {("c1", "k"), ("c2", "k")}
    members = spark.createDataFrame([("A", 1, "field", False, "f"), ("A", 2, "method", False, "m"), ("A", 3, "block", False, "b"), ("A", 4, "block", True, "s")], "type string, pos int, kind string, static boolean, node string")
    assert {tuple(r) for r in constructors.type_initialisers(members).collect()} == {("A", 1, "f"), ("A", 3, "b")}
    assert {r.node for r in constructors.type_initialisers(members, static=True).collect()} == {"s"}
