"""Straight lines, the search along them, the tree of post-dominators and linear reaching, against plain versions."""

import random

import pytest

from graphloom.operators import control, dataflow, exceptions, fixpoint, lines


def graph(rng, proc, base):
    nodes = [base + i for i in range(rng.randint(1, 12))]
    arcs = {(a, b) for a, b in zip(nodes, nodes[1:], strict=False) if rng.random() < 0.85} | {tuple(rng.choices(nodes, k=2)) for _ in range(rng.randint(0, 3))}
    return [(proc, n) for n in nodes], [(proc, a, b) for a, b in arcs]


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(5)
    made = [graph(rng, p, 100 * p) for p in range(60)]
    ring = [(60, 6000 + i, 6000 + (i + 1) % 7) for i in range(7)]
    nodes = [n for g in made for n in g[0]] + [(60, 6000 + i) for i in range(7)] + [(61, 6100)]
    return nodes, [a for g in made for a in g[1]] + ring + [(61, 6100, 6100)]


def test_lines_against_plain(spark, graphs):
    arcs = graphs[1]
    got = {r.node: (r.line, r.pos) for r in lines.straight_lines(spark.createDataFrame(arcs, "proc long, src long, dst long")).collect()}
    outs, ins = {}, {}
    for _, a, b in arcs:
        outs.setdefault(a, []).append(b)
        ins.setdefault(b, []).append(a)
    prev = {b: ins[b][0] for b in ins if len(ins[b]) == 1 and len(outs[ins[b][0]]) == 1 and ins[b][0] != b}
    for n in {*outs, *ins}:
        way = [n]
        while way[-1] in prev and prev[way[-1]] not in way:
            way.append(prev[way[-1]])
        if way[-1] in prev:  # a circle
            way = way[: way.index(min(way)) + 1]
        assert got.pop(n) == (way[-1], len(way) - 1)
    assert not got
    assert lines.straight_lines(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_search_along_lines(spark, graphs, monkeypatch):
    rng = random.Random(8)
    nodes, arcs = graphs
    pick = lambda k, also=(): {(p, n, rng.choice([*"xy", *also])) for p, n in rng.choices(nodes, k=k)}
    starts = spark.createDataFrame([(p, i % 40, v, n) for i, (p, n, v) in enumerate(sorted(pick(150)))], "proc long, key long, var string, node long")
    walls = spark.createDataFrame(list(pick(60)), "proc long, node long, var string")
    marks = spark.createDataFrame(list(pick(600, [None])), "proc long, node long, var string")
    frame = spark.createDataFrame(arcs, "proc long, src long, dst long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    small = rows(fixpoint.search(starts, frame, walls, marks))
    assert len(small) > 200
    monkeypatch.setattr(fixpoint, "PROC_ARCS", 3)  # some procedures a task each, some along lines
    assert rows(fixpoint.search(starts, frame, walls, marks)) == small
    monkeypatch.setattr(fixpoint, "PROC_ARCS", 0)
    assert rows(fixpoint.search(starts, frame, walls, marks)) == small
    assert rows(fixpoint.search(starts, frame, walls.limit(0), marks)) != small


def test_long_line_takes_few_rounds(spark, monkeypatch):
    n, cuts = 20_000, []
    real = fixpoint.checkpoint
    monkeypatch.setattr(lines, "checkpoint", lambda df: cuts.append(1) or real(df))
    monkeypatch.setattr(fixpoint, "PROC_ARCS", 10_000)
    ids = spark.range(n - 1)
    arcs = ids.selectExpr("0L as proc", "id as src", "id + 1 as dst", "'EXEC' as kind")
    actions = spark.range(n).selectExpr("0L as proc", "id as node", "id as pos", "'v' as var", "if(id % 1000 = 0, 'DEF', 'USE') as op", "false as optional")
    got = dataflow.reaching(actions, arcs)
    assert got.count() == n - n // 1000 and got.where("use_id - def_id not between 1 and 999 or def_id % 1000 <> 0").isEmpty()
    assert len(cuts) < 30


def test_immediate_post_dominators(spark, graphs):
    nodes, arcs = graphs
    n, a = spark.createDataFrame(nodes, "proc long, node long"), spark.createDataFrame(arcs, "proc long, src long, dst long")
    above = {}
    for r in control.post_dominators(n, a).collect():
        above.setdefault(r.a, set()).add(r.b)
    sources = {s for _, s, _ in arcs}
    ends = {x for _, x in nodes if x not in sources}
    alive, more = set(ends), True
    while more:
        new = {s for _, s, d in arcs if d in alive} - alive
        more, alive = bool(new), alive | new
    tree = {r.node: r for r in control.immediate_post_dominators(n, a).collect()}
    assert set(tree) == alive
    for x, r in tree.items():
        way = []
        while (y := tree[way[-1] if way else x].above) is not None:
            way.append(y)
        assert set(way) == above.get(x, set()) & alive and len(way) == r.depth == len(set(way))

    rng = random.Random(3)
    returns = sorted({(p, p * 10 + rng.randint(0, 2), x) for p, x in rng.choices(nodes, k=200)})
    got = {r.call: r.target for r in exceptions.return_targets(control.immediate_post_dominators(n, a), spark.createDataFrame(returns, "proc long, call long, node long")).collect()}
    want = {}
    for call in {c for _, c, _ in returns}:
        over = [{x} | above.get(x, set()) & alive for _, c, x in returns if c == call and x in alive]
        shared = set.intersection(*over) if over else set()
        if shared:
            want[call] = max(shared, key=lambda x: tree[x].depth)
    assert got == want and len(want) > 20


def test_reaching_linear(spark):
    rng = random.Random(2)
    acts = [(p, 1000 * p + i, i, rng.choice("xy"), rng.choice(["USE", "DEF"]), rng.random() < 0.6) for p in range(20) for i in range(rng.randint(0, 25))]
    got = sorted(map(tuple, dataflow.reaching_linear(spark.createDataFrame(acts, "proc long, node long, pos int, var string, op string, optional boolean")).collect()))
    want = []
    for p, n, i, v, op, _ in acts:
        if op == "USE":
            for q, m, _, w, o, maybe in reversed([x for x in acts if x[0] == p and x[2] < i]):
                if w == v and o == "DEF":
                    want.append((n, m))
                    if not maybe:
                        break
    assert got == sorted(want) and want
