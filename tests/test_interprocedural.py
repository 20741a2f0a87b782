"""Slicers, summaries, sources and streams that SQL does not cover, against plain versions."""

import random

import pytest

from graphloom.functions import names
from graphloom.operators import constrained, interproc, pruning
from graphloom.sources import programs


def plain_slice(root, arcs, pseudo, stops):
    """The rules by trying every arc again until nothing changes."""
    kept, taken = {root}, set()
    kinds = lambda n: {a[2] for a in taken if a[0] == n}

    def take(a):
        taken.add(a)
        if kinds(a[0]) not in ({"CC1"}, {"CC2"}):
            kept.add(a[0])

    def barred(a):
        s, t, kind, _, _, exclusive = a
        ways = kinds(t)
        if t == root:
            return False
        if kind == "CD" and t in pseudo and ways <= {"CD"}:
            return True
        if ways and ways <= {"CC1", "CC2"} and not (kind == "CD" and exclusive):
            return True
        return kind == "OBJECT_FLOW" and "OBJECT_FLOW" not in ways and t not in stops

    for side in (4, 3):
        usable = [a for a in arcs if not a[side]]
        while new := [a for a in usable if a not in taken and a[1] in kept and not barred(a)]:
            take(new[0])
        while new := [a for a in usable if a not in taken and a[2] == "CC1" and kinds(a[1]) == {"CC1"}]:
            for a in new:
                take(a)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_exception_sensitive_slices(spark, seed):
    r = random.Random(seed)
    kinds = ["CD", "CD", "CC1", "CC2", "OBJECT_FLOW", "DATA", "CALL", "RETURN"]
    arcs = sorted({(r.randrange(25), r.randrange(25), k, k == "CALL", k == "RETURN", k == "CD" and r.random() < 0.5) for k in kinds * 7})
    arcs = list({a[:3]: a for a in arcs}.values())
    pseudo, stops = {1, 5, 9, 13}, {2, 5, 8, 20}
    got = constrained.exception_sensitive(
        spark.createDataFrame([(k, k) for k in range(25)], "key int, node int"),
        spark.createDataFrame(arcs, "src int, dst int, kind string, is_inter_in boolean, is_inter_out boolean, exclusive boolean"),
        spark.createDataFrame([(n, n in pseudo, n in stops) for n in sorted(pseudo | stops)], "node int, pseudo boolean, object_stop boolean"),
    ).collect()
    want = {(k, n) for k in range(25) for n in plain_slice(k, arcs, pseudo, stops)}
    assert sorted((x.criterion_id, x.node_id) for x in got) == sorted(want)


def test_summaries_through_recursion(spark):
    intra = spark.createDataFrame([("f.in", "f.out"), ("f.in", "c.in"), ("c.out", "f.out2"), ("m.in", "d.in"), ("d.out2", "m.out")], "src string, dst string")
    formals = spark.createDataFrame([("f", "f.in", "x", True), ("f", "f.out", "x", False), ("f", "f.out2", "y", False)], "proc string, node string, var string, is_input boolean")
    rows = [(c, "f", f"{c}.{n}", v, i) for c in ("c", "d") for n, v, i in (("in", "x", True), ("out", "x", False), ("out2", "y", False))]
    actuals = spark.createDataFrame(rows, "call string, proc string, node string, var string, is_input boolean")
    got = {(r.src, r.dst) for r in interproc.summary_arcs(intra, formals, actuals).collect()}
    # y depends on x only through f's call of itself.
    assert got == {(f"{c}.in", f"{c}.{o}") for c in ("c", "d") for o in ("out", "out2")}


def test_program_files_and_sliced_text(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "X.java").write_text("one\ntwo\nthree")
    (tmp_path / "a" / "note.txt").write_text("no")
    files = programs.source_files(spark, str(tmp_path))
    lines = programs.source_lines(files)
    kept = lines.where("line <> 2").select("file", "line")
    assert [r.text for r in pruning.sliced_text(lines, kept).collect()] == ["one\nthree"]


def test_locate_tries_fields_of_this(spark):
    c = programs.criteria(spark.createDataFrame([("A.java#3:x",), ("A.java#3",), ("A.java#03",)], "spec string"))
    nodes = spark.createDataFrame([(1, "A.java", 3, "this.x"), (2, "A.java", 3, "y"), (3, "A.java", 4, "x")], "node int, file string, line long, name string")
    assert sorted((r.spec, r.node) for r in programs.locate(c, nodes).collect()) == [("A.java#3", 1), ("A.java#3", 2), ("A.java#3:x", 1)]


def test_names(spark):
    df = spark.createDataFrame([("a.b.c",), ("Outer.this.x",), ("this",), ("a",)], "n string")
    got = df.select(names.root(df.n).alias("r"), names.fields(df.n).alias("f")).collect()
    assert [tuple(r) for r in got] == [("a", "b.c"), ("Outer.this", "x"), ("this", ""), ("a", "")]


def test_closure_of_a_stream(spark, tmp_path):
    from graphloom.streaming.closure import keep_closure

    seeds = spark.createDataFrame([(1, "a")], "key int, node string")
    for batch in ([("b", "c"), ("x", "y")], [("a", "b")], [("c", "d"), ("d", "a")]):
        spark.createDataFrame(batch, "src string, dst string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("src string, dst string").parquet(str(tmp_path / "in"))
        keep_closure(stream, seeds, str(tmp_path / "out")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "reached")).collect()
    assert sorted((r.key, r.node) for r in got) == [(1, n) for n in "abcd"]


@pytest.mark.parametrize("limit", [0, 5])
def test_exception_rounds_move_their_news_alone(spark, monkeypatch, limit):
    """Arcs may repeat, are moved once and lie by the node they lead into; a round moves the rows that go on and what they reach, never the arcs or what is known."""
    plans, was = [], constrained.keep

    def keep(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
        return was(df)

    monkeypatch.setattr(constrained, "keep", keep)
    monkeypatch.setattr(constrained, "SMALL", limit)
    r = random.Random(7)
    arcs = sorted({(r.randrange(20), r.randrange(20), k, k == "CALL", k == "RETURN", False) for k in ["CD", "CC1", "CC2", "OBJECT_FLOW", "DATA", "CALL", "RETURN"] * 6})
    arcs = list({a[:3]: a for a in arcs}.values())
    got = constrained.exception_sensitive(
        spark.createDataFrame([(k, k) for k in range(20)], "key int, node int"),
        spark.createDataFrame(arcs * 2, "src int, dst int, kind string, is_inter_in boolean, is_inter_out boolean, exclusive boolean"),
        spark.createDataFrame([(3, True, False), (3, True, False), (4, False, True)], "node int, pseudo boolean, object_stop boolean"),
    ).collect()
    assert sorted((x.criterion_id, x.node_id) for x in got) == sorted((k, n) for k in range(20) for n in plain_slice(k, arcs, {3}, {4}))
    # The first plan lays out the arcs, the second the criteria.
    assert len(plans) > 4 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans[2:])


@pytest.mark.parametrize("limit", [0, 100])
def test_summary_rounds_move_their_news_alone(spark, monkeypatch, limit):
    """Random programs against a plain version; after the tables are laid out a plan moves passes and summaries, or steps, once each."""
    plans, was = [], interproc.keep

    def keep(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
        return was(df)

    monkeypatch.setattr(interproc, "keep", keep)
    monkeypatch.setattr(interproc, "SMALL", limit)
    r = random.Random(limit)
    formals = [(p, f"{p}.{v}.{i}", v, i) for p in "fgh" for v in "xy" for i in (True, False)]
    actuals = [(c, p, f"{c}.{v}.{i}", v, i) for c, p in (("a", "f"), ("b", "g"), ("c", "h"), ("d", "f")) for v in "xy" for i in (True, False)]
    inside = {"f": [*"b"], "g": [*"cd"], "h": [*"a"]}
    nodes = {p: [n for q, n, _, _ in formals if q == p] + [n for c, _, n, _, _ in actuals if c in inside[p]] for p in "fgh"}
    intra = {(r.choice(nodes[p]), r.choice(nodes[p])) for p in "fgh" for _ in range(9)}
    want = set()
    while True:
        arcs, grown = intra | want, set()
        for p, at, v, _ in (f for f in formals if not f[3]):
            seen, todo = {at}, [at]
            while todo:
                t = todo.pop()
                todo += [x for x, y in arcs if y == t and x not in seen]
                seen |= {x for x, y in arcs if y == t}
            into = {w for q, m, w, i in formals if q == p and i and m in seen}
            grown |= {(f"{c}.{w}.True", f"{c}.{v}.False") for c in {c for c, q, *_ in actuals if q == p} for w in into}
        if grown <= want:
            break
        want |= grown
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = interproc.summary_arcs(frame(sorted(intra), "src string, dst string"), frame(formals, "proc string, node string, var string, is_input boolean"), frame(actuals, "call string, proc string, node string, var string, is_input boolean"))
    assert want and sorted((x.src, x.dst) for x in got.collect()) == sorted(want)
    assert len(plans) > 7 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans)


def test_arcs_of_calls_are_moved_before_they_are_made_distinct(spark):
    """Arcs that repeat come once, and the joins' tasks hold no table of them."""
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    sites = frame([("c", "site", "f"), ("c", "site", "f"), ("d", "site2", "gone")], "call string, node string, callee string")
    actuals = frame([("c", "in", "x", True), ("c", "in", "x", True), ("c", "out", "x", False)], "call string, node string, var string, is_input boolean")
    formals = frame([("f", "f.in", "x", True), ("f", "f.out", "x", False)], "callee string, node string, var string, is_input boolean")
    df = interproc.connect_calls(sites, frame([("f", "enter")], "callee string, node string"), actuals, formals)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert "REPARTITION_BY_COL" in plan[1] and "HashAggregate" not in plan[1]
    assert sorted(map(tuple, df.collect())) == [("f.out", "out", "PARAM_OUT"), ("in", "f.in", "PARAM_IN"), ("site", "enter", "CALL")]
