"""Trees across calls against plain work lists and hand-made cases."""

import random

from graphloom.operators import interproc, objects


def test_propagated_trees(spark):
    rng = random.Random(9)
    direct, passes, stops, silent = set(), set(), set(), set()
    names = ["a", "b", "this"]
    for p in range(25):
        for _ in range(rng.randint(0, 2)):
            direct.add((p, rng.choice(names), rng.choice(["", "x", "x/y", f"m{p % 4}"])))
        for k in range(rng.randint(0, 3)):
            call, callee = f"{p}-{k}", rng.randrange(25)
            for param in names:
                for v in rng.sample(names, rng.randint(0, 2)):
                    passes.add((call, p, callee, param, v))
                if rng.random() < 0.2:
                    stops.add((call, param))
        if rng.random() < 0.15:
            silent.add((p, "a"))
    state = direct | {(p, v, "") for p, v, _ in direct}
    while True:
        sites = {(call, param, v, path, sum(x[:4] == (call, caller, callee, param) for x in passes) > 1) for call, caller, callee, param, v in passes for p, var, path in state if (p, var) == (callee, param) and (p, var) not in silent}
        more = {(caller, v, path) for call, caller, callee, param, v in passes for p, var, path in state if (p, var) == (callee, param) and (p, var) not in silent and (call, v) not in stops}
        if more <= state:
            break
        state |= more
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    args = frame(direct, "proc int, var string, path string"), frame(passes, "call string, caller int, callee int, param string, var string"), frame(stops, "call string, var string")
    seen, acted = interproc.propagate_trees(*args, frame(silent, "proc int, var string"))
    got = [tuple(r) for r in acted.collect()]
    assert {tuple(r) for r in seen.collect()} == state and seen.count() == len(state) > len(direct) + 20
    assert set(got) == sites and len(got) == len(sites) and any(x[4] for x in sites)
    seen, acted = interproc.propagate_trees(args[0].limit(0), *args[1:])
    assert seen.count() == acted.count() == 0


def test_roots(spark):
    rng = random.Random(2)
    parent = {f"n{i}": f"n{rng.randrange(i)}" if i > 5 else f"top{i % 2}" for i in range(1, 200)}
    parent |= {f"l{i}": f"l{i - 1}" for i in range(1, 40)} | {"n0": "top0"}

    def top(n):
        while n in parent:
            n = parent[n]
        return n

    got = objects.tree_roots(spark.createDataFrame(list(parent.items()), "node string, parent string"))
    assert {r.node: r.root for r in got.collect()} == {n: top(n) for n in parent}


def test_objects_across_calls(spark):
    pairs = spark.createDataFrame([("ain", "fin", True, False), ("bin", "pin", False, False), ("fout", "aout", True, False), ("out", "ret", True, True), ("vout", "vret", False, True)], "src string, dst string, is_object boolean, is_output boolean")
    actions = spark.createDataFrame(
        [("ain", 1, "1", None), ("ain", 2, "2", "R2"), ("fin", 1, "3", "R3"), ("fin", 2, "4", "R4"), ("fout", 1, "5", "R5"), ("aout", 1, "6", None), ("out", 1, "7", "R7"), ("ret", 1, "8", "R8")], "node string, pos int, action string, root string"
    )
    tree = [("2", "x"), ("2", "x/y"), ("3", "x"), ("3", "x/y"), ("4", "x"), ("5", "x"), ("7", "x"), ("8", "x")]
    members = spark.createDataFrame([(a, p, f"{a}:{p}", f"R{a}" if "/" not in p else f"{a}:{p.rsplit('/', 1)[0]}") for a, p in tree], "action string, path string, node string, parent string")
    kinds = {"ain": "ACTUAL_IN", "bin": "ACTUAL_IN", "fin": "FORMAL_IN", "pin": "FORMAL_IN", "fout": "FORMAL_OUT", "aout": "ACTUAL_OUT", "out": "OUTPUT", "ret": "CALL_RETURN", "vout": "OUTPUT", "vret": "CALL_RETURN"}
    got = {tuple(r) for r in objects.object_call_arcs(pairs, actions, members, spark.createDataFrame(list(kinds.items()), "node string, kind string")).collect()}
    into, out = (True, False), (False, True)
    want = {("ain", "fin", False, *into), ("bin", "pin", False, *into), ("fout", "aout", False, *out), ("vout", "vret", False, *out), ("R5", "aout", False, *out)}
    for a, b, way in (("2", "3", into), ("2", "4", into), ("7", "8", out)):
        want |= {(f"R{a}", f"R{b}", o, *way) for o in (False, True)} | {(f"{a}:x", f"{b}:x", False, *way)}
    want |= {("2:x", "3:x", True, *into), ("2:x/y", "3:x/y", False, *into)}
    assert got == want
    # Each arc goes one way; an enum meets the inputs of its name.
    assert all(r[3] != r[4] for r in got)
    types = spark.createDataFrame([("t1", "E", "enum"), ("t2", "C", "class")], "action string, name string, kind string")
    formals = spark.createDataFrame([("f1", "E", True), ("f2", "E", False), ("f3", "C", True)], "action string, var string, is_input boolean")
    assert [tuple(r) for r in objects.enum_links(types, formals).collect()] == [("t1", "", "f1", "")]


def test_structure(spark):
    calls = spark.createDataFrame([("c", "s", "CALL"), ("c:1", "c", "ACTUAL_IN")], "node string, parent string, kind string")
    actions = spark.createDataFrame([(1, "s", "a", "c:1", "Ra"), (1, "s", "b", None, "Rb"), (1, "s", "c", None, None), (1, "exit", "d", "fo", None), (1, "s", "e", "in", None)], "proc int, node string, action string, real string, root string")
    members = spark.createDataFrame([("Ra:x", "Ra")], "node string, parent string")
    exits = spark.createDataFrame([(1, "exit", "enter")], "proc int, node string, enter string")
    assert {tuple(r) for r in objects.structure(calls, actions, members, exits).collect()} == {("s", "c"), ("c", "c:1"), ("c:1", "Ra"), ("s", "Rb"), ("enter", "fo"), ("s", "in"), ("Ra", "Ra:x")}
    thrown = spark.createDataFrame([("s", "-activeException-", "DEF", "R"), ("s", "-activeException-", "USE", "Q"), ("t", "-activeException-", "DEF", None)], "node string, var string, op string, root string")
    assert [tuple(r) for r in objects.thrown_values(thrown).collect()] == [("R", "s")]


def test_trees_read_what_procedures_do_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            reads.add(1)
            yield r

    schema = "proc string, var string, path string"
    direct = spark.createDataFrame(spark.createDataFrame([("o", "a", "m"), ("o", "b", "")], schema).rdd.mapPartitions(seen), schema)
    passes = spark.createDataFrame([("s", "c", "o", "a", "x")], "call string, caller string, callee string, param string, var string")
    stops = spark.createDataFrame([], "call string, var string")
    trees, _ = interproc.propagate_trees(direct, passes, stops)
    assert sorted(map(tuple, trees.collect())) == [("c", "x", ""), ("c", "x", "m"), ("o", "a", ""), ("o", "a", "m"), ("o", "b", "")]
    assert reads.value == 2
