"""Criteria, ranges of source and written files against plain versions."""

import os
import random

from graphloom.operators import criteria, pruning


def test_units(spark):
    files = spark.createDataFrame([("u1", "/a/X.java"), ("u2", "/b/X.java")], "unit string, path string")
    types = spark.createDataFrame([("u1", "a.X"), ("u2", "b.X"), ("u2", "b.Y")], "unit string, type string")
    asked = spark.createDataFrame([("1", "/b/X.java", None), ("2", "X.java", None), ("3", None, "b.Y"), ("4", None, "Y"), ("5", None, None), ("6", "/a/X.java", "b.Y")], "spec string, file string, class string")
    assert {tuple(r) for r in criteria.units_of(asked, files, types).collect()} == {("1", "u2"), ("3", "u2"), ("5", "u1"), ("6", "u1")}
    assert criteria.units_of(asked, files.limit(0), types.limit(0)).count() == 0


def test_containing(spark):
    rng = random.Random(6)

    def span():
        a = rng.randint(-200, 5000)
        return a, a + rng.choice([0, 1, 2, 7, 8, 60, 900, 5000])

    outer = [(f"n{i}", rng.choice("uvw"), *span()) for i in range(400)]
    inner = [(f"k{i}", rng.choice("uvwx"), *span()) for i in range(300)]
    want = {}
    for k, u, a, b in inner:
        around = [(e - s, -s, n) for n, v, s, e in outer if v == u and s <= a and e >= b]
        if around:
            want[k] = min(around)[2]
    schema = "unit string, start long, end long"
    got = criteria.containing(spark.createDataFrame(inner, f"key string, {schema}"), spark.createDataFrame(outer, f"node string, {schema}"))
    assert {r.key: r.node for r in got.collect()} == want and 100 < len(want) < 300


def test_declarations(spark):
    vertices = spark.createDataFrame([(1, "p.A", "f(int)"), (2, "q.A", "f(int)"), (3, "p.A", "g()"), (4, "B", "f(int)")], "vertex int, type string, signature string")
    declared = spark.createDataFrame([("a", "p.A", "f(int)"), ("b", "r.A", "f(int)"), ("c", "A", "g()"), ("d", "B", "g()")], "key string, type string, signature string")
    assert {tuple(r) for r in criteria.by_declaration(declared, vertices).collect()} == {("a", 1), ("b", 1), ("b", 2), ("c", 3)}


def test_variable_nodes(spark):
    actions = spark.createDataFrame([("n1", "a1", "v", "r1"), ("n1", "a2", "i", None), ("n2", "a3", "this.w", None), ("n2", "a4", "this", "r4"), ("n3", "a5", "v", "r5")], "node string, action string, name string, root string")
    members = spark.createDataFrame([("a1", "<T>", "t"), ("a1", "<T>/x", "tx"), ("a1", "<S>/x", "sx"), ("a1", "<S>/x/y", "sxy"), ("a4", "<C>/x", "cx"), ("a5", "x", "x5")], "action string, path string, node string")
    wanted = [("all", None), ("v", "v"), ("i", "i"), ("vx", "v.x"), ("vxy", "v.x.y"), ("vz", "v.z"), ("w", "w"), ("tx", "this.x"), ("x", "x"), ("none", "none")]
    df = spark.createDataFrame([(s, n, v) for s, v in wanted for n in ("n1", "n2")], "spec string, node string, variable string")
    got = {}
    for r in criteria.variable_nodes(df, actions, members).collect():
        got.setdefault(r.spec, set()).add(r.node)
    assert got == {"all": {"n1", "n2"}, "v": {"r1"}, "i": {"n1"}, "vx": {"tx", "sx"}, "vxy": {"sxy"}, "w": {"n2"}, "tx": {"cx"}, "x": {"cx"}}


def test_written_sources(spark, tmp_path):
    rows = [("/s/A.java", "p.q", "class A {\n}", "/s/A.java", 3, "x"), ("/s/B.java", None, None, "/s/A.java", 3, None)]
    pruning.write_sources(spark.createDataFrame(rows, "file string, package string, text string, origin string, line int, variable string"), str(tmp_path / "out"))
    found = {}
    for place, _, names in os.walk(tmp_path / "out"):
        for n in names:
            if n.startswith("part-"):
                found[os.path.relpath(place, tmp_path / "out")] = open(os.path.join(place, n)).read()
    head = "/*\n\tPart of a program: what may affect {} in line 3 of /s/A.java.\n\tTaken from {}\n*/\n"
    named = {"package=p.q/name=A.java": head.format("x", "/s/A.java") + "class A {\n}\n", "package=__HIVE_DEFAULT_PARTITION__/name=B.java": head.format("anything", "/s/B.java") + "\n"}
    assert found == named
