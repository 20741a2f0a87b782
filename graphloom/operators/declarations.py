"""Declarations in data flow, and dependences of object members, an action at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dataflow
from .fixpoint import checkpoint, search


def action_graph(actions: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions and arcs with a node for each action instead of a statement.

    ``actions(proc, node, pos, action, ...)``, ``arcs(proc, src, dst, kind)``;
    ids of actions and nodes are strings that do not meet. A statement's actions
    follow one another, arcs lead from its last to the first of the next; a
    statement without actions stays. What holds for nodes of the result holds for actions.
    """
    order = Window.partitionBy("proc", "node").orderBy("pos")
    chain = actions.select("proc", F.col("action").alias("src"), F.lead("action").over(order).alias("dst"), F.lit("EXEC").alias("kind")).where("dst is not null")
    ends = actions.groupBy("proc", "node").agg(F.min_by("action", "pos").alias("first"), F.max_by("action", "pos").alias("last"))
    end = lambda at, to: ends.select("proc", F.col("node").alias(at), F.col(to).alias(f"_{at}"))
    led = arcs.join(end("src", "last"), ["proc", "src"], "left").join(end("dst", "first"), ["proc", "dst"], "left")
    led = led.select("proc", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "kind")
    return actions.withColumn("statement", F.col("node")).withColumn("node", F.col("action")), led.union(chain)


def declaration_flow(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(src, dst, label)``: from the declaration of a variable that is nearest on a way back from a definition to that definition.

    ``actions`` as for :func:`dataflow.reaching`, op USE, DEF or DEC, with
    ``synthetic``; synthetic definitions have no declaration.
    """
    op = F.when(F.col("op") == "DEC", "DEF").otherwise("USE")
    seen = actions.where("op = 'DEC' or op = 'DEF' and not synthetic").select("proc", "node", "pos", "var", op.alias("op"), F.lit(False).alias("optional"))
    return dataflow.data_dependence(seen, arcs)


def undeclared(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(proc, node, var)``: definitions that no declaration of their procedure reaches, those that callers see."""
    met = declaration_flow(actions, arcs).select(F.col("dst").alias("node"), F.col("label").alias("var"))
    return actions.where("op = 'DEF' and not synthetic").select("proc", "node", "var").distinct().join(met, ["node", "var"], "left_anti").select("proc", "node", "var")


def field_declarations(actions: DataFrame, members: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(src, dst, member)``: from the declaration of a field to every later definition of ``this`` that holds the field.

    ``actions(proc, node, pos, action, var, op)`` as of :func:`action_graph`
    with its arcs; a field's declaration acts on ``this.field``.
    ``members(action, path, node)``, '/' between the parts of a path, types among
    them in angle brackets; these do not count. The arc ends at the member.
    """
    plain = F.array_join(F.filter(F.split("path", "/"), lambda x: ~x.startswith("<")), ".")
    typed = F.element_at(F.split("path", "/"), -1).startswith("<")
    held = members.where(~typed).select("action", F.concat(F.lit("this."), plain).alias("var"), F.col("node").alias("member"))
    declared = actions.where("op = 'DEC' and var like 'this.%'")
    walk = arcs.where("kind = 'EXEC'").select("proc", "src", "dst")
    starts = declared.join(walk.withColumnRenamed("src", "node"), ["proc", "node"]).select("proc", F.col("node").alias("key"), "var", F.col("dst").alias("node")).distinct()
    defs = actions.where("op = 'DEF' and var = 'this'").drop("var").join(held, "action")
    met = search(starts, walk, defs.select("proc", "node", "var").limit(0), defs.select("proc", "node", "var").distinct())
    ends = defs.select("node", "var", F.col("action").alias("dst"), "member")
    return met.join(ends, ["node", "var"]).select(F.col("key").alias("src"), "dst", "member").distinct()


def member_dependence(actions: DataFrame, members: DataFrame, totals: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` between members of objects.

    ``actions(proc, node, pos, action, var, op, optional, synthetic)`` of objects
    as of :func:`action_graph` with its arcs, ``members(action, path, node)``,
    ``totals(action, path)``: members that a definition defines fully. A used
    member gets FLOW from the last definitions that hold it, and TOTAL_DEF, as a
    defined one does, from the last declarations that hold it or definitions
    that define it fully. A defined member gives OBJECT_FLOW to its own root.
    Both searches read actions and arcs that are written once.
    """
    arcs = checkpoint(arcs.where("kind = 'EXEC'").select("proc", "src", "dst", "kind"))
    held = members.select("action", "path", F.col("node").alias("member"))
    at = held.join(actions, "action").select("proc", "node", "pos", "action", F.concat_ws("\x1f", "var", "path").alias("var"), "op", "optional", "synthetic", "member", "path")
    at = checkpoint(at.join(totals.select("action", "path", F.lit(True).alias("total")).distinct(), ["action", "path"], "left"))
    row = lambda df, op, later: df.select("proc", "node", (F.col("pos") * 2 + later).alias("pos"), "var", F.lit(op).alias("op"), "optional")

    def arcs_of(targets: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
        met = dataflow.data_dependence(row(targets, "USE", 0).union(row(sources, "DEF", 1)), arcs)
        end = lambda df, c: df.select(F.col("node").alias(c), F.col("var").alias("label"), F.col("member").alias(f"{c}_member"))
        named = met.join(end(sources, "src"), ["src", "label"]).join(end(targets, "dst"), ["dst", "label"])
        return named.select(F.col("src_member").alias("src"), F.col("dst_member").alias("dst"), F.lit(kind).alias("kind"))

    used, defined = at.where("op = 'USE'"), at.where("op = 'DEF'")
    full = at.where("op = 'DEC' or op = 'DEF' and total")
    out = arcs_of(used, defined, "FLOW").union(arcs_of(used.union(defined.where("not synthetic")), full, "TOTAL_DEF"))
    return out.union(defined.select("member", "action", F.lit("OBJECT_FLOW"))).distinct()
