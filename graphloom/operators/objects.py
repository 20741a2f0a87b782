"""Object trees across statements and calls: connections of trees and values, object flow, merged and moved actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dataflow, graphs
from .fixpoint import checkpoint


def _subtree(links: DataFrame, side: str, roots: DataFrame, members: DataFrame) -> DataFrame:
    """``(link, <side>_path, <side>_node, <side>_inner)`` of the part of an action's tree below a member.

    The member itself has path ''. An action without a tree gives its own node under a null path.
    """
    member = F.col(f"{side}_member")
    action = links.select("link", F.col(f"{side}_action").alias("action"), member)
    top = action.join(roots, "action").where((member == "") | ~F.col("has_tree"))
    top = top.select("link", F.when(F.col("has_tree"), "").alias("path"), "node", F.lit(True).alias("inner"))
    below = action.join(members, "action").where((member == "") | (F.col("path") == member) | F.col("path").startswith(F.concat(member, F.lit("/"))))
    cut = F.when(member == "", F.col("path")).otherwise(F.substring("path", F.length(member) + 2, F.length("path")))
    return top.union(below.select("link", cut, "node", "inner")).toDF("link", f"{side}_path", f"{side}_node", f"{side}_inner")


def with_inner(members: DataFrame) -> DataFrame:
    """``members(action, path, node)`` with ``inner``: whether other members stand below it."""
    parents = members.where(F.col("path").contains("/")).select("action", F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("inner", F.lit(True))
    return members.join(parents, ["action", "path"], "left").select("action", "path", "node", F.coalesce("inner", F.lit(False)).alias("inner"))


def connect_trees(links: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` of connections between two trees, or parts of them.

    ``links(src_action, src_member, dst_action, dst_member)`` with '' for a
    whole tree, ``roots(action, node, has_tree)``, ``members(action, path, node)``.
    The tops get FLOW and OBJECT_FLOW, and so does each shared member that has
    members in the target; the others get FLOW. Where one side has no tree the
    tops get FLOW alone.
    """
    link = F.struct("src_action", "src_member", "dst_action", "dst_member")
    links = links.distinct().withColumn("link", link)
    members = with_inner(members)
    src, dst = _subtree(links, "src", roots, members), _subtree(links, "dst", roots, members)
    shared = src.join(dst, (src["link"] == dst["link"]) & (F.col("src_path") == F.col("dst_path")))
    flow = shared.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), ((F.col("dst_path") == "") | F.col("dst_inner")).alias("inner"))
    tops = lambda df, side: df.where(F.coalesce(F.col(f"{side}_path"), F.lit("")) == "")
    bare = tops(src, "src").join(tops(dst, "dst"), "link").where("(src_path is null or dst_path is null) and src_node <> dst_node")
    flow = flow.union(bare.select("src_node", "dst_node", F.lit(False)))
    kinds = F.when(F.col("inner"), F.array(F.lit("FLOW"), F.lit("OBJECT_FLOW"))).otherwise(F.array(F.lit("FLOW")))
    return flow.select("src", "dst", F.explode(kinds).alias("kind")).distinct()


def connect_values(values: DataFrame, members: DataFrame) -> DataFrame:
    """``(src, dst)`` from a member to the statement that uses its value. ``values(action, path, statement)``, ``members(action, path, node)``."""
    return values.join(members, ["action", "path"]).select(F.col("node").alias("src"), F.col("statement").alias("dst")).distinct()


def object_dependence(actions: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` of each variable or member of an object.

    ``actions`` as for :func:`dataflow.reaching`, with ``primitive``. Uses of a
    primitive get FLOW from the definitions that reach them. Uses of an object
    get OBJECT_FLOW instead, and TOTAL_DEF from those that define it fully;
    each definition of an object gets OBJECT_FLOW to the next ones.
    """
    arc = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("kind"))
    name = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    actions, arcs = checkpoint(actions), checkpoint(arcs)  # read by four searches, several times each
    plain, objects = actions.where("primitive"), actions.where("not primitive")
    flow = arc(name(dataflow.reaching(plain, arcs), "def_id", "use_id"), "FLOW")
    used = arc(name(dataflow.reaching(objects, arcs), "def_id", "use_id"), "OBJECT_FLOW")
    later = arc(name(dataflow.next_definitions(objects, arcs), "def_id", "next_id"), "OBJECT_FLOW")
    return flow.union(used).union(later).union(arc(dataflow.total_definitions(objects, arcs), "TOTAL_DEF")).distinct()


def merged_actions(actions: DataFrame) -> DataFrame:
    """``(proc, node, var, op, optional, members, n)``: runs of actions of one kind on one variable as one.

    ``actions(proc, node, pos, var, op, optional, member)``. A run ends at
    another variable or kind, after an action on the whole variable (null
    member), and around declarations. The last action says whether the run is optional.
    """
    order = Window.partitionBy("proc").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    joins = (before("var") == F.col("var")) & (before("op") == F.col("op")) & (F.col("op") != "DEC") & before("member").isNotNull()
    runs = actions.withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("proc", "run").agg(
        F.min_by("node", "pos").alias("node"),
        F.min("var").alias("var"),
        F.min("op").alias("op"),
        F.max_by("optional", "pos").alias("optional"),
        F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"),
        F.count(F.lit(1)).alias("n"),
    ).drop("run")


def moved(arcs: DataFrame, moves: DataFrame) -> DataFrame:
    """Arcs whose ends are moved to the nodes that stand for them. ``arcs(src, dst, kind)``, ``moves(node, real)`` with one row for a node."""

    def end(df: DataFrame, c: str) -> DataFrame:
        to = moves.select(F.col("node").alias(c), F.col("real").alias("_real"))
        new: Column = F.coalesce("_real", c)
        return df.join(to, c, "left").withColumn(c, new).drop("_real")

    return end(end(arcs.select("src", "dst", "kind"), "src"), "dst").select("src", "dst", "kind").distinct()


def tree_roots(parents: DataFrame) -> DataFrame:
    """``(node, root)``: what each node of ``parents(node, parent)`` hangs below in the end; steps double, so rounds grow with the logarithm of the depth."""
    up = checkpoint(parents.select("node", F.col("parent").alias("root")).distinct())
    while True:
        over = up.select(F.col("node").alias("root"), F.col("root").alias("_over"))
        step = up.join(over, "root", "left").select("node", F.coalesce("_over", "root").alias("root"), F.col("_over").isNotNull().alias("_moved"))
        step = checkpoint(step)
        up = step.select("node", "root")
        if step.where("_moved").isEmpty():
            return up


def object_call_arcs(pairs: DataFrame, actions: DataFrame, members: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(src, dst, object_flow, is_in, is_out)``: what sites and declarations hand each other.

    ``pairs(src, dst, is_object, is_output)`` of nodes that :mod:`interproc`
    matched, from actual to formal inputs, formal to actual outputs, and outputs
    to returns; ``actions(node, pos, action, root)``, ``root`` null without a
    tree; ``members(action, path, node, parent)``; ``kinds(node, kind)`` of
    inputs and outputs. Of objects, the source's last action is connected with
    every action of the target, tree by tree; a plain arc stands beside these
    but for outputs. Whether an arc goes into a callee or out of it is told by
    the nodes that the trees hang below.
    """
    plain = pairs.where("not (is_object and is_output)").select("src", "dst", F.lit(False).alias("object_flow"))
    last = actions.groupBy("node").agg(F.max_by("action", "pos").alias("src_action")).withColumnRenamed("node", "src")
    given = actions.select(F.col("node").alias("dst"), F.col("action").alias("dst_action"))
    links = pairs.where("is_object").join(last, "src").join(given, "dst").select("src_action", F.lit("").alias("src_member"), "dst_action", F.lit("").alias("dst_member"))
    roots = actions.select("action", F.coalesce("root", "node").alias("node"), F.col("root").isNotNull().alias("has_tree"))
    trees = connect_trees(links, roots, members.select("action", "path", "node"))
    out = plain.union(trees.select("src", "dst", F.col("kind") == "OBJECT_FLOW")).distinct()
    above = tree_roots(members.select("node", "parent").union(actions.where("root is not null").select("root", "node")))
    held = above.join(kinds.select(F.col("node").alias("root"), F.col("kind").alias("root_kind")), "root").select("node", "root_kind").union(kinds.select("node", "kind")).distinct()
    return out.join(graphs.inout_direction(out, held), ["src", "dst"]).select("src", "dst", "object_flow", "is_in", "is_out")


def enum_links(types: DataFrame, formals: DataFrame) -> DataFrame:
    """Links for :func:`connect_trees` from the tree of an enum, ``types(action, name, kind)``, to each formal input, ``formals(action, var, is_input)``, of its name."""
    enums = types.where("kind = 'enum'").select(F.col("action").alias("src_action"), F.col("name").alias("var"))
    met = enums.join(formals.where("is_input").select(F.col("action").alias("dst_action"), "var"), "var")
    return met.select("src_action", F.lit("").alias("src_member"), "dst_action", F.lit("").alias("dst_member")).distinct()


def structure(calls: DataFrame, actions: DataFrame, members: DataFrame, exits: DataFrame) -> DataFrame:
    """STRUCTURAL ``(src, dst)`` arcs of synthetic nodes and trees.

    ``calls(node, parent, kind)`` as of :func:`actions.call_nodes`;
    ``actions(proc, node, action, real, root)`` with the node that stands for an
    action, if another; ``members(node, parent)``; ``exits(proc, node, enter)``.
    A call hangs below its statement and its inputs and outputs below the call;
    other nodes that stand for actions below the statement, or the entry if that
    is the exit; a tree's root below its action's node, members below their parents.
    """
    below = actions.where("real is not null").select("proc", "node", F.col("real").alias("dst")).join(calls.select(F.col("node").alias("dst")), "dst", "left_anti")
    top = below.join(exits, ["proc", "node"], "left").select(F.coalesce("enter", "node").alias("src"), "dst")
    trees = actions.where("root is not null").select(F.coalesce("real", "node").alias("src"), F.col("root").alias("dst"))
    return calls.select(F.col("parent").alias("src"), F.col("node").alias("dst")).union(top).union(trees).union(members.select("parent", "node")).distinct()


def thrown_values(actions: DataFrame) -> DataFrame:
    """``(src, dst)`` from the tree of what a statement throws to the statement; ``actions(node, var, op, root)``."""
    return actions.where("op = 'DEF' and var = '-activeException-' and root is not null").select(F.col("root").alias("src"), F.col("node").alias("dst")).distinct()
