"""Straight lines of a graph: runs of nodes that can only be passed one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import checkpoint


def straight_lines(arcs: DataFrame) -> DataFrame:
    """``(node, line, pos)`` for all nodes of ``arcs(src, dst)``: the first node of its line and how far down that it stands, from 0.

    A line goes on where a node's only way out is its target's only way in.
    Distances double each round, so a line of n nodes takes about log2(n)
    rounds. A circle without a way in begins at its least node.
    """
    arcs = checkpoint(arcs.select("src", "dst").distinct())
    once = lambda c: arcs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(c)
    links = arcs.where("src <> dst").join(once("src"), "src").join(once("dst"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("jump"))
    links = checkpoint(links)
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    done, circles = _double(nodes.join(links, "node", "left_anti"), links)
    if not circles.isEmpty():
        cut, _ = _double(circles.where("node = least").select("node"), links.join(circles.where("node <> least").select("node"), "node"))
        done = done.union(cut)
    return done


def _double(heads: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads and all nodes linked below them as ``(node, line, pos)``; the other nodes with the ``least`` of their circle."""
    begin = heads.select("node", F.col("node").alias("jump"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("least"), F.lit(False).alias("going"))
    state = checkpoint(begin.union(links.select("node", "jump", F.lit(1).cast("long"), F.least("node", "jump"), F.lit(True))))
    n, span = state.count(), 1
    going = state.where("going")
    while span < 2 * n and not going.isEmpty():
        to = state.select(F.col("node").alias("jump"), F.col("jump").alias("to"), F.col("pos").alias("more"), F.col("least").alias("below"), F.col("going").alias("on"))
        moved = going.join(to, "jump").select("node", F.col("to").alias("jump"), F.col("pos") + F.col("more"), F.least("least", "below"), "on")
        state, span = checkpoint(state.where("not going").union(moved)), 2 * span
        going = state.where("going")
    return state.where("not going").select("node", F.col("jump").alias("line"), "pos"), going.select("node", "least")


def search_lines(starts: DataFrame, arcs: DataFrame, walls: DataFrame, marks: DataFrame) -> DataFrame:
    """``fixpoint.search`` by joins: a round goes down a whole straight line, so rounds grow with the branches of a way, not its nodes.

    Walls cut each line, for their variable, into parts: a search that enters a
    part sees what is marked below in it and goes no further, or leaves by the
    line's end where no wall is left. Nodes are told apart without ``proc``.
    """
    lines = checkpoint(straight_lines(arcs))
    place = lambda df: df.join(lines, "node", "left").withColumn("line", F.coalesce("line", "node")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    source = lines.select(F.col("node").alias("src"), "line")
    onward = checkpoint(arcs.join(lines.where("pos = 0").select(F.col("node").alias("dst")), "dst").join(source, "src").select("line", F.col("dst").alias("next")).distinct())
    shape = starts.select("key", "var", "node")
    row = lambda df, role: df.select("node", "var", df["key"] if "key" in df.columns else F.lit(None).cast(starts.schema["key"].dataType).alias("key"), F.lit(role).alias("role"))
    rows = place(row(shape.distinct(), "start").union(row(walls.select("node", "var").distinct(), "wall")).union(row(marks.where("var is not null").select("node", "var").distinct(), "mark")))
    line = Window.partitionBy("line", "var")
    wall = F.when(F.col("role") == "wall", F.col("pos"))
    # Both frames grow row by row; walls before a row number its part, the nearest one from it on ends its way.
    rows = rows.withColumn("part", F.count(wall).over(line.orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)))
    rows = checkpoint(rows.withColumn("stop", F.min(wall).over(line.orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, Window.currentRow))))
    first = checkpoint(rows.where("role = 'wall'").groupBy("line", "var").agg(F.min("pos").alias("stop")))
    own = rows.where("role = 'start'").select("key", "var", "line", "pos", "part", "stop")
    leave = lambda df: df.join(onward, "line").select("key", "var", F.col("next").alias("line")).distinct()
    seen = delta = checkpoint(leave(own.where("stop is null")))
    rounds = 0
    while not delta.isEmpty():
        step = checkpoint(leave(delta.join(first, ["line", "var"], "left_anti")))
        delta = checkpoint(step.join(seen, ["key", "var", "line"], "left_anti"))
        seen, rounds = seen.union(delta), rounds + 1
        if rounds % 8 == 0:
            seen = checkpoint(seen)
    entered = seen.join(first, ["line", "var"], "left").select("key", "var", "line", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("part"), "stop")
    runs = checkpoint(own.union(entered)).withColumnRenamed("pos", "start")
    named = runs.join(rows.where("role = 'mark'").select("line", "var", "part", "pos", "node"), ["line", "var", "part"]).where("pos >= start")
    free = place(marks.where("var is null").select("node").distinct())
    free = runs.join(free, "line").where("pos >= start and (stop is null or pos <= stop)")
    return named.select("key", "var", "node").union(free.select("key", "var", "node")).distinct()
