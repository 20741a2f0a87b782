"""Control flow from statement tables against a plain walk over the tree."""

import random

from graphloom.operators import cfg
from graphloom.operators.hierarchy import ancestors, nearest_member
from graphloom.plans.bindings import PROGRAM

SCHEMA = "proc string, node string, parent string, part string, pos int, kind string, label string, target string"


def plain(rows, augmented, accurate=True):
    """Arcs of one procedure, by recursion."""
    kids, arcs = {}, set()
    for proc, node, parent, part, pos, kind, label, target in rows:
        kids.setdefault((parent, part), []).append((pos, node, kind, label, target))
    parts = lambda n: sorted(p for (parent, p) in kids if parent == n)
    proc = rows[0][0]

    def entry(s):
        _, node, kind, *_ = s
        body = sorted(kids.get((node, "body"), []))
        return entry(body[0]) if kind == "do" and body and accurate else node

    def block(stmts, after, around):
        for i, s in enumerate(stmts):
            statement(s, entry(stmts[i + 1]) if i + 1 < len(stmts) else after, around)

    def statement(s, after, around):
        _, n, kind, label, target = s
        get = lambda part: sorted(kids.get((n, part), []))
        start = lambda part, other: entry(get(part)[0]) if get(part) else other
        add = lambda d, k="EXEC": arcs.add((proc, n, d, k))
        if kind == "if":
            for part in ("then", "else"):
                add(start(part, after))
                block(get(part), after, [(kind, label, n, after, n), *around])
        elif kind in cfg.LOOPS:
            update = start("update", n)
            me = [(kind, label, n, after, update if accurate else n), *around]
            if accurate or get("body") or get("update"):
                add(start("body", update))
            add(after)
            block(get("body"), update, me)
            block(get("update"), n, me)
        elif kind == "switch":
            numbers = parts(n)
            default = next((get(p)[0][1] for p in numbers if get(p)[0][3] == "default"), None)
            for i, p in enumerate(numbers):
                add(entry(get(p)[0]))
                block(get(p), entry(get(numbers[i + 1])[0]) if i + 1 < len(numbers) else after, [(kind, label, n, after, n), *around])
                if augmented and get(p)[0][2] == "case" and get(p)[0][3] != "default":
                    arcs.add((proc, get(p)[0][1], default or after, "NONEXEC"))
            if default is None:
                add(after)
        elif kind in ("break", "continue"):
            fits = ("switch", *cfg.LOOPS) if kind == "break" else cfg.LOOPS
            to = next((a for a in around if (a[1] == target if target else a[0] in fits)), None)
            if to:
                add(to[3] if kind == "break" else to[4])
        elif kind == "return":
            add(f"exit:{proc}")
        else:
            add(after)
        if augmented and kind in cfg.JUMPS:
            add(after, "NONEXEC")

    top = sorted(kids[None, None])
    block(top, f"exit:{proc}", [])
    arcs.add((proc, f"enter:{proc}", entry(top[0]), "EXEC"))
    if augmented:
        arcs.add((proc, f"enter:{proc}", f"exit:{proc}", "NONEXEC"))
    return arcs


def some_program(rng, proc):
    rows = []

    def block(parent, part, depth, loops, first=None):
        for pos in range(1, rng.randint(1, 4) + 1):
            node = f"{proc}-{len(rows)}"
            if first and pos == 1:
                rows.append((proc, node, parent, part, pos, "case", first, None))
                continue
            inside = any(not x.startswith("switch") for x in loops)
            kinds = ["plain", "plain", "return"] + (["if", "while", "do", "for", "switch"] if depth < 3 else []) + (["break", "continue"] if inside else ["break"] if loops else [])
            kind = rng.choice(kinds)
            label = f"L{len(rows)}" if kind in cfg.LOOPS and rng.random() < 0.5 else None
            targets = [x for x in loops if x.startswith("L")]
            target = rng.choice(targets) if kind in ("break", "continue") and targets and rng.random() < 0.5 else None
            rows.append((proc, node, parent, part, pos, kind, label, target))
            if kind == "if":
                for p in ("then", "else"):
                    if rng.random() < 0.7:
                        block(node, p, depth + 1, loops)
            elif kind in cfg.LOOPS:
                if rng.random() < 0.85:
                    block(node, "body", depth + 1, [label or "loop", *loops])
                if kind == "for" and rng.random() < 0.7:
                    rows.append((proc, f"{proc}-{len(rows)}", node, "update", 1, "plain", None, None))
            elif kind == "switch":
                some = rng.randint(0, 3)
                for k in range(some):
                    block(node, str(k), depth + 1, ["switch", *loops], "default" if k == some - 1 and rng.random() < 0.5 else f"c{k}")

    block(None, None, 0, [])
    return rows


def test_control_flow_of_random_programs(spark):
    rng = random.Random(7)
    programs = [some_program(rng, f"p{k}") for k in range(60)]
    df = spark.createDataFrame([r for rows in programs for r in rows], SCHEMA)
    for augmented, accurate in ((False, False), (True, True), (True, False)):
        got = {tuple(r) for r in cfg.control_flow(df, augmented, accurate).collect()}
        want = set().union(*[plain(rows, augmented, accurate) for rows in programs])
        assert got == want


def test_the_bound_program():
    rows = [("p", *r) for r in PROGRAM]
    assert {x[1:] for x in plain(rows, True) if x[3] == "EXEC"} == {x[1:] for x in plain(rows, False)}


def test_ancestors_of_diamonds_and_circles(spark):
    types = spark.createDataFrame([(x,) for x in "abcdxy"], "type string")
    extends = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "child string, parent string")
    up = ancestors(types, extends)
    got = sorted(map(tuple, up.where("depth > 0").collect()))
    assert got == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 1), ("c", "d", 1), ("x", "y", 1), ("y", "x", 1)]
    members = spark.createDataFrame([("c", "m"), ("b", "m"), ("d", "k")], "owner string, name string")
    assert ("a", "m", "b") in set(map(tuple, nearest_member(up, members).collect()))
