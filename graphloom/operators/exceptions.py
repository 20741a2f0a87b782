"""Exceptions inside a procedure: sources, chains of catch clauses, and the dependences that a catch conditions."""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import checkpoint, per_procedure


def merged_sources(sources: DataFrame) -> DataFrame:
    """``(scope, node, type, active)``: each node and type once, active if any of its rows is."""
    return sources.groupBy("scope", "node", "type").agg(F.bool_or("active").alias("active"))


def _with_catcher(sources: DataFrame, catches: DataFrame, closure: DataFrame) -> DataFrame:
    """Types of each scope, and the first catch that takes all of their exceptions (null if none)."""
    types = sources.select("scope", "type").distinct()
    up = types.join(closure.select("type", "ancestor"), "type")
    taken = catches.select("scope", "pos", F.col("type").alias("ancestor"))
    first = up.join(taken, ["scope", "ancestor"]).groupBy("scope", "type").agg(F.min("pos").alias("caught_at"))
    return sources.join(first, ["scope", "type"], "left")


def catch_arcs(sources: DataFrame, catches: DataFrame, closure: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` into the catch clauses of each try.

    ``sources(scope, node, type, active)``, ``catches(scope, pos, node, type)``
    with positions from 1 and one row for each type of a clause,
    ``closure(type, ancestor, depth)``. Sources lead to the first clause, each
    clause to the next: EXEC while a type is still active, else NONEXEC. A
    clause ends the types that are assignable to its own.
    """
    left = _with_catcher(merged_sources(sources), catches, closure)
    clauses = catches.select("scope", "pos", F.col("node").alias("dst")).distinct()
    kind = lambda c: F.when(F.bool_or(c), "EXEC").otherwise("NONEXEC").alias("kind")
    into = left.join(clauses.where("pos = 1"), "scope").groupBy(F.col("node").alias("src"), "dst").agg(kind(F.col("active")))
    # What a clause passes on depends on the types alone, so sources are first brought down to one row a type.
    types = left.groupBy("scope", "type", "caught_at").agg(F.bool_or("active").alias("active"))
    pairs = clauses.join(clauses.select("scope", (F.col("pos") + 1).alias("pos"), F.col("dst").alias("src")), ["scope", "pos"])
    open_still = F.col("active") & (F.col("caught_at").isNull() | (F.col("caught_at") >= F.col("pos")))
    return into.union(pairs.join(types, "scope").groupBy("src", "dst").agg(kind(open_still)))


def uncaught(sources: DataFrame, catches: DataFrame, closure: DataFrame) -> DataFrame:
    """``(scope, type)`` that leave each try: active, and no clause takes them."""
    return _with_catcher(merged_sources(sources), catches, closure).where("active and caught_at is null").select("scope", "type").distinct()


def return_targets(tree: DataFrame, returns: DataFrame) -> DataFrame:
    """``(call, target)``: the first node that post-dominates all returns of a call; a node post-dominates itself.

    ``tree(proc, node, above, depth)`` from ``immediate_post_dominators``,
    ``returns(proc, call, node)``. The deepest of a call's nodes climbs until
    one is left. Returns that reach no end have no say; calls with such returns
    alone, or whose returns share no node, have no row.
    """

    def visit(proc, left, successors):
        up = {n: rows[0] for n, rows in successors.items()}
        ends = defaultdict(set)
        for call, n in zip(left["call"], left["node"], strict=True):
            if n in up and call is not None:
                ends[call].add(n)
        for call, at in ends.items():
            heap = [(-up[n].depth, n) for n in at]
            heapify(heap)
            while len(at) > 1 and heap[0][0] < 0:
                n = heappop(heap)[1]
                at.remove(n)
                if (above := up[n].dst) not in at:
                    at.add(above)
                    heappush(heap, (-up[above].depth, above))
            if len(at) == 1:
                yield call, at.pop()

    kind = lambda c: returns.schema[c].dataType.simpleString()
    arcs = tree.select("proc", F.col("node").alias("src"), F.coalesce("above", "node").alias("dst"), "depth")
    return per_procedure(returns.select("proc", "call", "node"), arcs, f"call {kind('call')}, target {kind('node')}", visit)


def conditional_dependence(control: DataFrame, catches: DataFrame, inside: DataFrame, within: DataFrame, sources: DataFrame, pseudo: DataFrame) -> DataFrame:
    """``(src, dst, kind)``: control dependence (CD) with the conditional kinds of catch clauses.

    ``control(src, dst)``, ``catches(node)``, ``inside(catch, node)``: what a
    clause holds, ``within(catch, node)``: what its try statement holds,
    ``sources(node)``: nodes that may throw, ``pseudo(node)``. An arc from a
    clause to a node outside it becomes CC1. A clause gets CC2 to each source in
    its try that it depends on by CD arcs within the try; the way back goes on
    from a pseudo-predicate only if that is the clause itself.
    """
    control = checkpoint(control.select("src", "dst").distinct())
    own = inside.select(F.col("catch").alias("src"), F.col("node").alias("dst")).distinct()
    one = checkpoint(control.join(catches.select(F.col("node").alias("src")), "src", "left_semi").join(own, ["src", "dst"], "left_anti"))
    stay = checkpoint(control.join(one, ["src", "dst"], "left_anti"))
    room = checkpoint(within.select("catch", F.col("node").alias("src")).distinct())
    seen = fresh = checkpoint(catches.select(F.col("node").alias("catch"), "node").distinct())
    ends = checkpoint(pseudo.select("node").distinct())
    active, rounds = fresh, 0
    while True:
        back = active.join(stay, F.col("node") == F.col("dst")).select("catch", "src").join(room, ["catch", "src"], "left_semi")
        fresh = checkpoint(back.select("catch", F.col("src").alias("node")).distinct().join(seen, ["catch", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        active = fresh.join(ends, "node", "left_anti").select("catch", "node")
        seen, rounds = seen.union(fresh), rounds + 1
        if rounds % 8 == 0:
            seen = checkpoint(seen)
    two = seen.join(sources.select("node").distinct(), "node", "left_semi").join(room.withColumnRenamed("src", "node"), ["catch", "node"], "left_semi")
    kind = lambda k: F.lit(k).alias("kind")
    return stay.select("src", "dst", kind("CD")).union(one.select("src", "dst", kind("CC1"))).union(two.select(F.col("catch").alias("src"), F.col("node").alias("dst"), kind("CC2")))
