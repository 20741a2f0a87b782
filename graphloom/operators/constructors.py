"""Constructors: what runs in them that nobody wrote, led into finished control flow; nodes of types and their initialisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_initialisers(members: DataFrame, static: bool = False) -> DataFrame:
    """``(type, pos, node)``: fields and initialiser blocks of a type in their order. ``members(type, pos, kind, static, node)``."""
    return members.where(F.col("kind").isin("field", "block") & (F.col("static") == static)).select("type", "pos", "node").distinct()


def initialiser_calls(calls: DataFrame, constructors: DataFrame) -> DataFrame:
    """``(proc, call)``: calls in initialisers, ``(call, type, static)``, belong to every constructor ``(proc, type)`` of the type; static ones to none."""
    return calls.where("not static").join(constructors.select("proc", "type").distinct(), "type").select("proc", "call").distinct()


def constructor_flow(arcs: DataFrame, constructors: DataFrame, initialisers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(proc, src, dst, kind)`` and ``(proc, node, implicit)``: control flow of constructors with what the language adds.

    ``arcs(proc, src, dst, kind)`` as written, ``constructors(proc, type, enter,
    exit, is_enum, implicit, opens, opening, returns)``, where ``opens`` is 'this',
    'super' or null, ``opening`` the node of that call and ``returns`` an array
    of return nodes; ``initialisers(type, pos, node)``.

    A class's constructor that begins with neither call gets ``super()`` at its
    start. Initialisers follow ``super()`` in order, a copy for each
    constructor; in an enum, which has none, they follow the entry. Where
    ``this()`` opens, another constructor runs them. All ways that end without a
    return pass an added ``return this``. Added nodes, and all nodes of an
    implicit constructor but its initialisers, are implicit.
    """
    named = lambda what: F.concat_ws(":", F.col("proc").cast("string"), what)
    alone = F.col("opens").isNull()
    c = constructors.withColumns({
        "super": F.when(alone & ~F.col("is_enum"), named(F.lit("super"))),
        "back": named(F.lit("return this")),
        "from": F.when(alone, F.col("enter")).when(F.col("opens") == "super", F.col("opening")),
    })
    # The nodes that go in one after another behind `from`: super() first, then the initialisers.
    own = c.where("from is not null").join(initialisers, "type").select("proc", F.lit(1).alias("rank"), "pos", named(F.col("node")).alias("node"), F.lit(False).alias("implicit"))
    added = c.where("super is not null").select("proc", F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.col("super").alias("node"), F.lit(True).alias("implicit")).unionByName(own)
    order = Window.partitionBy("proc").orderBy("rank", "pos", "node")
    chain = added.withColumn("next", F.lead("node").over(order))
    ends = added.groupBy("proc").agg(F.min_by("node", F.struct("rank", "pos", "node")).alias("first"), F.max_by("node", F.struct("rank", "pos", "node")).alias("last"))
    c = c.join(ends, "proc", "left")
    arc = lambda df, src: df.select("proc", src.alias("src"), F.col("dst"), F.col("kind"))
    # Arcs as written: led out of the chain's end, and into `return this` where nothing returned before.
    led = arcs.join(c.select("proc", "enter", "exit", "returns", "back", "from", "last"), "proc")
    out_of_exit: Column = (F.col("dst") == F.col("exit")) & ~F.when(F.col("kind") == "EXEC", F.array_contains("returns", F.col("src"))).otherwise(F.col("src") == F.col("enter"))
    led = led.withColumn("dst", F.when(out_of_exit, F.col("back")).otherwise(F.col("dst")))
    moved = F.when((F.col("kind") == "EXEC") & (F.col("src") == F.col("from")) & F.col("last").isNotNull(), F.col("last")).otherwise(F.col("src"))
    out = arc(led, moved)
    into = c.where("first is not null").select("proc", F.col("from").alias("src"), F.col("first").alias("dst"), F.lit("EXEC").alias("kind"))
    inner = chain.where("next is not null").select("proc", F.col("node").alias("src"), F.col("next").alias("dst"), F.lit("EXEC").alias("kind"))
    done = c.select("proc", F.col("back").alias("src"), F.col("exit").alias("dst"), F.lit("EXEC").alias("kind"))
    out = out.union(into).union(inner).union(done).distinct()
    written = arcs.select("proc", F.explode(F.array("src", "dst")).alias("node")).join(c.select("proc", "implicit"), "proc")
    new = added.select("proc", "node", "implicit").union(c.select("proc", "back", F.lit(True)))
    return out, written.select("proc", "node", "implicit").union(new).distinct()


def type_nodes(types: DataFrame, fields: DataFrame, constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, label, var)`` and STRUCTURAL ``(src, dst)``: a node for each type that defines its name, with its static fields below it.

    ``types(type, name, kind)``, ``fields(type, name, static)``; an enum's
    ``constants(type, name)`` count as static fields. The node has a tree, its
    root below the node and the members below the root.
    """
    node = F.concat(F.lit("type:"), F.col("type"))
    tree = F.concat(F.lit("tree:"), F.col("type"))
    nodes = types.select(node.alias("node"), F.concat_ws(" ", "kind", "name").alias("label"), F.col("name").alias("var")).distinct()
    static = fields.where("static").select("type", F.col("name").alias("member"))
    enums = constants.select("type", F.col("name").alias("member")).join(types.where("kind = 'enum'").select("type"), "type", "left_semi")
    below = static.union(enums).join(types.select("type"), "type", "left_semi").distinct()
    arcs = types.select(node.alias("src"), tree.alias("dst")).union(below.select(tree, F.concat(tree, F.lit("/"), F.col("member"))))
    return nodes, arcs.distinct()
