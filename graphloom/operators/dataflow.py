"""Reaching definitions and data dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import search


def reaching_linear(actions: DataFrame) -> DataFrame:
    """``(use_id, def_id)`` in straight-line code: the last plain definition before a use and the optional ones after it.

    ``actions(proc, node, pos, var, op, optional)``. Plain definitions cut each
    procedure's actions on a variable into parts, each beginning with one; a use
    meets the definitions of its own part that stand before it.
    """
    order = Window.partitionBy("proc", "var").orderBy("pos")
    plain = F.when((F.col("op") == "DEF") & ~F.col("optional"), 1)
    defs = actions.withColumn("part", F.count(plain).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("op = 'DEF'")
    uses = actions.withColumn("part", F.count(plain).over(order.rangeBetween(Window.unboundedPreceding, -1))).where("op = 'USE'")
    defs = defs.select("proc", "var", "part", F.col("node").alias("def_id"), "pos")
    return uses.select("proc", "var", "part", F.col("node").alias("use_id"), F.col("pos").alias("at")).join(defs, ["proc", "var", "part"]).where("pos < at").select("use_id", "def_id")


def _defs(actions: DataFrame, plain: bool = False) -> DataFrame:
    """``(proc, node, var)`` of definitions; a node that defines a variable several times is there once."""
    kinds = actions.where("op = 'DEF' and not optional" if plain else "op = 'DEF'")
    return kinds.select("proc", "node", "var").distinct()


def _at(actions: DataFrame, op: str, later: bool) -> DataFrame:
    """``(proc, node, var, met, ended)`` of the actions ``op``, once a node and variable.

    ``met``: some other definition of the variable stands before it in its own
    node (``later``: after it); ``ended``: for each such action one of them is plain.
    """
    order = Window.partitionBy("proc", "node", "var").orderBy("pos")
    frame = order.rowsBetween(1, Window.unboundedFollowing) if later else order.rowsBetween(Window.unboundedPreceding, -1)
    defines = F.col("op") == "DEF"
    some = lambda c: F.coalesce(F.max(c.cast("int")).over(frame), F.lit(0)) == 1
    marked = actions.withColumn("met", some(defines)).withColumn("ended", some(defines & ~F.col("optional")))
    return marked.where(F.col("op") == op).groupBy("proc", "node", "var").agg(F.bool_or("met").alias("met"), F.bool_and("ended").alias("ended"))


def _backwards(actions: DataFrame, arcs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uses, and the marked nodes ``(key, var, node)`` met on the ways back from each; a plain definition ends a way."""
    into = arcs.where("kind = 'EXEC'").select("proc", F.col("dst").alias("src"), F.col("src").alias("dst"))
    uses = _at(actions, "USE", later=False)
    starts = uses.where("not ended").join(into.withColumnRenamed("src", "node"), ["proc", "node"]).select("proc", F.col("node").alias("key"), "var", F.col("dst").alias("node")).distinct()
    return uses, search(starts, into, _defs(actions, plain=True), marks)


def reaching(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(use_id, def_id)`` over executable arcs of each procedure.

    ``actions(proc, node, pos, var, op, optional)``: a node may have any number
    of them, in the order of ``pos``. A use is reached by definitions that stand
    before it in its own node, and, unless one of these is plain, by those of
    other nodes, its own among them if a way leads round to it.
    """
    return _reaching(actions, arcs).select("use_id", "def_id").distinct()


def _reaching(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    uses, met = _backwards(actions, arcs, _defs(actions))
    own = uses.where("met").select(F.col("node").alias("use_id"), F.col("node").alias("def_id"), "var")
    return met.select(F.col("key").alias("use_id"), F.col("node").alias("def_id"), "var").union(own).distinct()


def completely_defined(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """Uses that no way from an entry reaches without a plain definition; a node all of whose uses are such."""
    walk = arcs.where("kind = 'EXEC'")
    nodes = actions.select("proc", "node").union(arcs.select("proc", "src")).distinct()
    entries = nodes.join(walk.select("proc", F.col("dst").alias("node")).distinct(), ["proc", "node"], "left_anti")
    uses, met = _backwards(actions, arcs, entries.withColumn("var", F.lit(None).cast(actions.schema["var"].dataType)))
    open_ways = met.join(_defs(actions, plain=True).select("node", "var"), ["node", "var"], "left_anti").select("key", "var")
    at_once = uses.where("not ended").join(entries, ["proc", "node"], "left_semi").select(F.col("node").alias("key"), "var")
    bad = open_ways.union(at_once).select(F.col("key").alias("use_id")).distinct()
    return uses.select(F.col("node").alias("use_id")).distinct().join(bad, "use_id", "left_anti")


def data_dependence(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(src, dst, label)``: definition to use, labelled with the variable."""
    return _reaching(actions, arcs).select(F.col("def_id").alias("src"), F.col("use_id").alias("dst"), F.col("var").alias("label"))


def total_definitions(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(src, dst)``: definitions that fully define what a use reads; optional ones left out."""
    uses, met = _backwards(actions, arcs, _defs(actions, plain=True))
    before = Window.partitionBy("proc", "node", "var").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.coalesce(F.max(((F.col("op") == "DEF") & ~F.col("optional")).cast("int")).over(before), F.lit(0)) == 1
    own = actions.withColumn("plain", plain).where("op = 'USE' and plain").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return met.select(F.col("node").alias("src"), F.col("key").alias("dst")).union(own).distinct()


def next_definitions(actions: DataFrame, arcs: DataFrame, all_later: bool = False) -> DataFrame:
    """``(def_id, next_id)``: definitions of the same variable met forwards until a plain one; with ``all_later`` every one."""
    walk = arcs.where("kind = 'EXEC'").select("proc", "src", "dst")
    defs = _at(actions, "DEF", later=True)
    going = defs if all_later else defs.where("not ended")
    starts = going.join(walk.withColumnRenamed("src", "node"), ["proc", "node"]).select("proc", F.col("node").alias("key"), "var", F.col("dst").alias("node")).distinct()
    walls = _defs(actions, plain=True)
    met = search(starts, walk, walls.limit(0) if all_later else walls, _defs(actions))
    own = defs.where("met").select(F.col("node").alias("def_id"), F.col("node").alias("next_id"))
    return met.select(F.col("key").alias("def_id"), F.col("node").alias("next_id")).union(own).distinct()
