"""Declarations, fields and members in data flow against plain searches over random programs."""

import random

from graphloom.operators import dataflow, declarations

PATHS = ["x", "x/y", "<T>", "<T>/x", "<T>/z"]


def program(rng, proc):
    nodes = [f"{proc}.{i}" for i in range(rng.randint(2, 9))]
    arcs = {(a, b) for a, b in zip(nodes, nodes[1:], strict=False) if rng.random() < 0.85} | {tuple(rng.choices(nodes, k=2)) for _ in range(rng.randint(0, 4))}
    acts = []
    for n in nodes:
        for i in range(rng.randint(0, 3)):
            op = rng.choice(["USE", "DEF", "DEF", "DEC"])
            var = rng.choice(["a", "this", "this.x"])
            held = set() if var == "this.x" else set(rng.sample(PATHS, rng.randint(0, 3)))
            acts.append({"proc": proc, "node": n, "pos": i, "action": f"{n}#{i}", "var": var, "op": op, "optional": op != "DEC" and rng.random() < 0.3, "synthetic": rng.random() < 0.2, "held": held, "full": {p for p in held if op == "DEF" and rng.random() < 0.6}})
    return nodes, arcs, acts


def back(acts, arcs, one, match, ends):
    """Actions that match on the ways back from an action, each way up to the first that ends it."""
    at, out, seen = {}, set(), set()
    for a in acts:
        at.setdefault(a["node"], []).append(a)

    def scan(some):
        for a in reversed(some):
            if match(a):
                out.add(a["action"])
                if ends(a):
                    return True
        return False

    todo = []
    if not scan([a for a in at[one["node"]] if a["pos"] < one["pos"]]):
        todo = [s for s, d in arcs if d == one["node"]]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            if not scan(at.get(n, [])):
                todo += [s for s, d in arcs if d == n]
    return out


def frames(spark, seed, n=40):
    rng = random.Random(seed)
    programs = [program(rng, p) for p in range(n)]
    acts = [a for p in programs for a in p[2]]
    cols = ("proc", "node", "pos", "action", "var", "op", "optional", "synthetic")
    df = spark.createDataFrame([tuple(a[c] for c in cols) for a in acts], "proc int, node string, pos int, action string, var string, op string, optional boolean, synthetic boolean")
    arcs = spark.createDataFrame([(i, s, d, "EXEC") for i, p in enumerate(programs) for s, d in p[1]], "proc int, src string, dst string, kind string")
    members = spark.createDataFrame([(a["action"], p, f"{a['action']}:{p}") for a in acts for p in a["held"]], "action string, path string, node string")
    totals = spark.createDataFrame([(a["action"], p) for a in acts for p in a["full"]], "action string, path string")
    return programs, declarations.action_graph(df, arcs), members, totals


def test_declaration_flow(spark):
    programs, (acts, arcs), _, _ = frames(spark, 2)
    want = set()
    for _, flow, own in programs:
        for a in own:
            if a["op"] == "DEF" and not a["synthetic"]:
                want |= {(d, a["action"]) for d in back(own, flow, a, lambda x, a=a: x["op"] == "DEC" and x["var"] == a["var"], lambda x: True)}
    got = {(r.src, r.dst) for r in declarations.declaration_flow(acts, arcs).collect()}
    assert got == want and len(want) > 30
    every = {a["action"] for p in programs for a in p[2] if a["op"] == "DEF" and not a["synthetic"]}
    assert {r.node for r in declarations.undeclared(acts, arcs).collect()} == every - {d for _, d in want}
    # The graph of actions says of actions what the graph of statements says of statements.
    want = set()
    for _, flow, own in programs:
        for a in own:
            if a["op"] == "USE":
                want |= {(d, a["action"]) for d in back(own, flow, a, lambda x, a=a: x["op"] == "DEF" and x["var"] == a["var"], lambda x: not x["optional"])}
    assert {(r.src, r.dst) for r in dataflow.data_dependence(acts, arcs).collect()} == want


def test_field_declarations(spark):
    programs, (acts, arcs), members, _ = frames(spark, 3)
    want = set()
    for _, flow, own in programs:
        for a in own:
            if a["op"] == "DEC" and a["var"] == "this.x":
                seen, todo = set(), [d for s, d in flow if s == a["node"]]
                while todo:
                    n = todo.pop()
                    if n not in seen:
                        seen.add(n)
                        todo += [d for s, d in flow if s == n]
                for x in own:
                    if x["op"] == "DEF" and x["var"] == "this" and (x["node"] in seen or x["node"] == a["node"] and x["pos"] > a["pos"]):
                        want |= {(a["action"], x["action"], f"{x['action']}:{p}") for p in x["held"] if p in ("x", "<T>/x")}
    assert {tuple(r) for r in declarations.field_declarations(acts, members, arcs).collect()} == want and len(want) > 10


def test_member_dependence(spark):
    programs, (acts, arcs), members, totals = frames(spark, 5)
    want = set()
    for _, flow, own in programs:
        for a in own:
            for p in a["held"]:
                me = f"{a['action']}:{p}"
                same = lambda x, a=a: x["var"] == a["var"]
                if a["op"] == "USE":
                    want |= {(f"{d}:{p}", me, "FLOW") for d in back(own, flow, a, lambda x, p=p, same=same: same(x) and x["op"] == "DEF" and p in x["held"], lambda x: not x["optional"])}
                if a["op"] == "USE" or a["op"] == "DEF" and not a["synthetic"]:
                    want |= {(f"{d}:{p}", me, "TOTAL_DEF") for d in back(own, flow, a, lambda x, p=p, same=same: same(x) and (x["op"] == "DEC" and p in x["held"] or p in x["full"]), lambda x: not x["optional"])}
                if a["op"] == "DEF":
                    want.add((me, a["action"], "OBJECT_FLOW"))
    got = {tuple(r) for r in declarations.member_dependence(acts, members, totals, arcs).collect()}
    assert got == want and {k for *_, k in want} == {"FLOW", "TOTAL_DEF", "OBJECT_FLOW"} and len(want) > 100


def test_members_are_searched_in_written_actions_and_arcs(spark):
    """What both searches of member dependence read is worked out once, not by each of them again."""
    from graphloom.queries import QUERIES

    plan = QUERIES["member_dependence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" not in plan and "FileScan" not in plan
