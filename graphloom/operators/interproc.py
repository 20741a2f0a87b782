"""What crosses calls: actions of callees, arcs between sites and declarations, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import SMALL, checkpoint, keep


def propagate(direct: DataFrame, calls: DataFrame, local: DataFrame) -> DataFrame:
    """``(proc, var)``: variables that a procedure, or one it calls, acts on and that are not its own.

    ``direct(proc, var)``, ``calls(caller, callee)``, ``local(proc, var)``. A
    variable stops at the procedure that declares it. All procedures advance
    together, so recursion ends when a round adds nothing.
    """
    calls = calls.select("caller", "callee").distinct()
    key = ["proc", "var"]
    seen = delta = checkpoint(direct.select(*key).distinct().join(local, key, "left_anti"))
    rounds = 0
    while True:
        up = delta.join(calls, F.col("proc") == F.col("callee")).select(F.col("caller").alias("proc"), "var").distinct()
        delta = checkpoint(up.join(local, key, "left_anti").join(seen, key, "left_anti"))
        if delta.isEmpty():
            return seen
        seen, rounds = seen.union(delta), rounds + 1
        if rounds % 8 == 0:
            seen = checkpoint(seen)


def propagate_trees(direct: DataFrame, passes: DataFrame, stops: DataFrame, silent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Variables and members that calls act on: ``(proc, var, path)`` of procedures and ``(call, param, var, path, optional)`` of sites.

    ``direct(proc, var, path)``: parameters and fields that a procedure itself
    acts on, path '' for the variable and 'a/b' for a member; ``passes(call,
    caller, callee, param, var)``: what a callee's parameter, or its ``this``, is
    at a site, a row for each variable it may be. What a site does, its
    procedure does too, save for ``stops(call, var)``: those that are local
    there, or, for uses, defined on every way to the site. Actions on a
    parameter that may be several variables are optional. ``silent(proc, var)``:
    parameters whose actions stay inside, as definitions of primitives do.
    Whoever acts on a member acts on its variable. All sites advance together
    and a round joins only what the last one added, so recursion ends when no
    tree grows.
    """
    key, site = ["proc", "var", "path"], ["call", "param", "var", "path"]
    whole = direct.select("proc", "var", F.explode(F.array("path", F.lit(""))).alias("path"))
    # Links lie by their site while they are made, then by their callee, where rounds meet them.
    links = passes.select("call", "caller", "callee", "param", "var").repartition("call").distinct()
    links = links.withColumn("optional", F.count(F.lit(1)).over(Window.partitionBy("call", "callee", "param")) > 1)
    links = links.join(stops.select("call", "var", F.lit(True).alias("stop")).repartition("call").distinct(), ["call", "var"], "left").repartition("callee")
    if silent is not None:
        links = links.join(silent.select(F.col("proc").alias("callee"), F.col("var").alias("param")).repartition("callee"), ["callee", "param"], "left_anti")
    on = keep(links.select("call", "caller", F.col("callee").alias("proc"), "param", F.col("var").alias("to"), F.col("stop").isNull().alias("goes"), "optional"))
    seen = delta = keep(whole.repartition("proc").distinct())
    sites = on.limit(0).select("call", "param", F.col("to").alias("var"), F.lit("").alias("path"), "optional")
    rounds = 0
    while True:
        met = keep(delta.withColumnRenamed("var", "param").join(on, ["proc", "param"]).select("call", "caller", "param", F.col("to").alias("var"), "path", "optional", "goes"))
        sites = sites.union(met.select(*site, "optional"))
        # Distinct first: where many sites lie in few callers, little goes there.
        up = met.where("goes").select(F.col("caller").alias("proc"), "var", "path").distinct()
        delta = keep(up.repartition("proc").join(seen, key, "left_anti"))
        if delta.isEmpty():
            return seen, sites.groupBy(*site).agg(F.bool_or("optional").alias("optional"))
        seen, rounds = seen.union(delta), rounds + 1
        if rounds % 8 == 0:
            seen, sites = keep(seen), checkpoint(sites)


def connect_calls(sites: DataFrame, entries: DataFrame, actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` between call sites and what they call.

    ``sites(call, node, callee)``, ``entries(callee, node)``,
    ``actuals(call, node, var, is_input)``, ``formals(callee, node, var, is_input)``.
    Parameters meet by name and direction. Callees without an entry (no body) give no arc.
    """
    targets = sites.join(entries.select("callee", F.col("node").alias("entry")), "callee")
    call = targets.select(F.col("node").alias("src"), F.col("entry").alias("dst"), F.lit("CALL").alias("kind"))
    pairs = actuals.withColumnRenamed("node", "actual").join(targets.select("call", "callee"), "call").join(formals.withColumnRenamed("node", "formal"), ["callee", "var", "is_input"])
    into = F.col("is_input")
    passed = pairs.select(
        F.when(into, F.col("actual")).otherwise(F.col("formal")).alias("src"),
        F.when(into, F.col("formal")).otherwise(F.col("actual")).alias("dst"),
        F.when(into, "PARAM_IN").otherwise("PARAM_OUT").alias("kind"),
    )
    # Moved before they are made distinct, so that no task holds a table of them beside the sorts of the joins.
    return call.union(passed).repartition("src", "dst").distinct()


def connect_exceptions(exits: DataFrame, returns: DataFrame, closure: DataFrame) -> DataFrame:
    """``(src, dst)``: each exit to the return of its own type at the call, else of the nearest ancestor that has one.

    ``exits(call, node, type)``, ``returns(call, node, type)`` with one row for
    a call and type, ``closure(type, ancestor, depth)`` with depth 0 for the type itself.
    """
    up = exits.join(closure, "type").select("call", F.col("node").alias("src"), F.col("ancestor").alias("type"), "depth")
    met = up.join(returns.withColumnRenamed("node", "dst"), ["call", "type"])
    return met.groupBy("call", "src").agg(F.min_by("dst", "depth").alias("dst")).select("src", "dst")


def summary_arcs(intra: DataFrame, formals: DataFrame, actuals: DataFrame) -> DataFrame:
    """``(src, dst)`` from an actual input to an actual output of the same call, if the callee passes one to the other.

    ``intra(src, dst)``: dependences inside procedures.
    ``formals(proc, node, var, is_input)``, ``actuals(call, proc, node, var, is_input)``
    where ``proc`` is the callee. New summaries lengthen paths in callers, and
    these give new summaries, until nothing is added; a round joins only what
    the last one brought. Arcs, summaries, inputs and what reaches an output lie
    by the node a way goes back from, actuals by their callee, and are moved
    once; a round moves its own news alone.
    """
    key = ["proc", "out_var", "node"]
    arcs = keep(intra.select("src", F.col("dst").alias("node")).repartition("node").distinct().sortWithinPartitions("node"))
    ins = keep(formals.where("is_input").select("proc", "node", F.col("var").alias("in_var")).repartition("node").sortWithinPartitions("node"))
    given = keep(actuals.where("is_input").select("call", "proc", "node", F.col("var").alias("in_var")).repartition("proc").sortWithinPartitions("proc", "in_var")).withColumnRenamed("node", "src")
    taken = keep(actuals.where("not is_input").select("call", "proc", "node", F.col("var").alias("out_var")).repartition("proc"))
    fresh = keep(formals.where("not is_input").select("proc", F.col("var").alias("out_var"), "node").repartition("node").distinct())
    # What is known stays in the parts that rounds have written, up to eight: a union of them would not lie by node.
    paths, summaries = [fresh], []
    few = lambda df, n: F.broadcast(df) if n <= SMALL else df
    back = lambda p, a: p.join(a, "node").select("proc", "out_var", F.col("src").alias("node"))
    union = lambda parts: reduce(DataFrame.union, parts)
    besides = lambda df, parts, on: reduce(lambda left, part: left.join(part, on, "left_anti"), parts, df)
    whole = lambda parts: [keep(union(parts).repartition("node"))] if len(parts) > 8 else parts
    while n := fresh.count():
        passes = few(fresh, n).join(ins, ["node", "proc"]).select("proc", "in_var", "out_var").repartition("proc").distinct()
        found = passes.join(given, ["proc", "in_var"]).join(taken, ["call", "proc", "out_var"]).select("src", "node").repartition("node").distinct()
        new = keep(besides(found, summaries, ["src", "node"]))
        steps = [back(few(fresh, n), part) for part in (arcs, *summaries)]
        if m := new.count():
            summaries = whole([*summaries, new])
            steps += [back(part, few(new, m)) for part in paths]
        fresh = keep(besides(union(steps).repartition("node").distinct(), paths, key))
        paths = whole([*paths, fresh])
    return union(summaries or [arcs.where("false")]).select("src", F.col("node").alias("dst"))
