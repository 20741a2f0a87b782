"""Which variables an expression's value may come from, and what that links in object trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .actions import OUTPUT, THIS
from .fixpoint import keep

#: Children that a value may come from, by kind of expression; other kinds than these and NOTHING hand on all of theirs, without the member path.
COMES_FROM = {"inner": (1,), "field": (1,), "array": (1,), "choice": (2, 3), "assign": (2,), "assign_op": (2,)}
#: Kinds of no variable's value.
NOTHING = ("literal", "lambda", "class", "array_new", "array_init", "method_ref", "pattern")
#: Children through which an argument may be handed out of a call again; other kinds hand out nothing.
HANDS_OUT = {"inner": (1,), "field": (1,), "array": (1,), "choice": (2, 3), "assign": (1, 2), "assign_op": (1, 2)}
_ENDS = ("name", "this", "call")


def _followed(rules: dict[str, tuple[int, ...]], others: bool) -> Column:
    """Whether the visit goes on to the child, by its parent's kind and its position."""
    out = None
    for kind, positions in rules.items():
        met = F.col("child_pos").isin(*positions)
        out = F.when(F.col("kind") == kind, met) if out is None else out.when(F.col("kind") == kind, met)
    return out.otherwise(F.lit(others) & ~F.col("kind").isin(*NOTHING, *_ENDS))


def _ends(expressions: DataFrame, roots: DataFrame, rules: dict[str, tuple[int, ...]], others: bool, linked: DataFrame | None = None) -> DataFrame:
    """``(node, root, expr, kind, name, path)`` of the names, ``this`` and, of those ``linked``, calls that the rules lead to; one level of all expressions a round.

    An expression stands in the statement of its parent, so all rows lie by
    ``node`` and are moved once; where ``roots`` and ``linked`` have that column
    too, they are not looked up by expression.
    """
    on = lambda df: ["node", "expr"] if "node" in df.columns else ["expr"]
    known = expressions.where("expr is not null").select("node", "expr", "parent", F.col("pos").cast("int").alias("pos"), "kind", "name").repartition("node")
    if linked is None:
        known = known.withColumn("ends", F.col("kind").isin("name", "this"))
    else:
        known = known.join(linked.select(*on(linked), F.lit(True).alias("linked")).distinct(), on(linked), "left").repartition("node")
        known = known.withColumn("ends", F.col("kind").isin("name", "this") | (F.col("kind") == "call") & F.coalesce("linked", F.lit(False))).drop("linked")
    known = keep(known)
    child = known.where("parent is not null").select("node", F.col("parent").alias("expr"), F.col("expr").alias("child"), F.col("pos").alias("child_pos"), F.col("kind").alias("child_kind"), F.col("name").alias("child_name"), F.col("ends").alias("child_ends"))
    first = roots.select(*(["node"] if "node" in roots.columns else []), F.col("root").alias("expr")).distinct()
    level = keep(known.join(first, on(first)).select("node", F.col("expr").alias("root"), "expr", "kind", "name", "ends", F.array().cast("array<string>").alias("path")).repartition("node"))
    out = None
    while True:
        here = level.where("ends").select("node", "root", "expr", "kind", "name", "path")
        out = here if out is None else out.union(here)
        path = F.when(F.col("kind") == "field", F.concat(F.array("name"), "path")).when(F.col("kind").isin(*rules), F.col("path")).otherwise(F.array().cast("array<string>"))
        below = level.where(~F.col("kind").isin(*NOTHING, *_ENDS)).join(child, ["node", "expr"]).where(_followed(rules, others))
        level = keep(below.select("node", "root", F.col("child").alias("expr"), F.col("child_kind").alias("kind"), F.col("child_name").alias("name"), F.col("child_ends").alias("ends"), path.alias("path")))
        if level.isEmpty():
            return out


def result_trees(expressions: DataFrame, roots: DataFrame, linked: DataFrame) -> DataFrame:
    """``(root, expr, var, path)``: where the value of each expression of ``roots(root)`` may come from.

    ``expressions`` as :func:`.actions.expression_actions` takes them,
    ``linked(expr)`` the calls whose callable is known. A name or ``this`` gives
    itself, a field the member ``path`` of what its scope gives, parentheses and
    casts what they hold, a choice both of its branches, an array what its name
    gives, an assignment what its value gives, a linked call its OUTPUT, another
    call nothing, nor do NOTHING's kinds. Operators give what their operands
    give, without the path.
    """
    ends = _ends(expressions, roots, COMES_FROM, True, linked)
    return ends.select("root", "expr", F.when(F.col("kind") == "call", OUTPUT).when(F.col("kind") == "this", THIS).otherwise(F.col("name")).alias("var"), "path")


def transfers(results: DataFrame, targets: DataFrame) -> DataFrame:
    """``(expr, var, path, target, member, kind)``: each result of a root linked to the action that takes its value.

    ``targets(root, target, member, has_tree)``: a TREE link, whose members go
    over one by one, where the target has an object tree, else a VALUE link of
    the source's member alone.
    """
    kind = F.when(F.coalesce("has_tree", F.lit(False)), "TREE").otherwise("VALUE")
    return results.join(targets, "root").select("expr", "var", "path", "target", F.when(kind == "TREE", F.col("member")).alias("member"), kind.alias("kind"))


def out_variables(expressions: DataFrame, arguments: DataFrame) -> DataFrame:
    """``(root, expr, var, optional)``: variables that a call may change through an argument of ``arguments(root)``: those that it reaches through fields, arrays, parentheses, casts, choices and assignments. They are optional where an argument has several."""
    ends = _ends(expressions, arguments, HANDS_OUT, False)
    several = F.count(F.lit(1)).over(Window.partitionBy("node", "root")) > 1
    return ends.select("root", "expr", F.when(F.col("kind") == "this", THIS).otherwise(F.col("name")).alias("var"), several.alias("optional"))
