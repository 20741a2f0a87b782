"""Slices whose steps depend on how a node was reached: exceptions, pseudo-predicates and object flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import SMALL, checkpoint, keep

STATE = ["key", "node"]

#: A node's state is one number: the sorts of traversed arcs that leave it, whether it is a criterion, and which arcs into it have been followed.
CD, CC1, CC2, OBJECT, OTHER, ROOT = (1 << i for i in range(6))
SORTS, FIRST = CD | CC1 | CC2 | OBJECT | OTHER, 6
#: Arcs into a node by the rule that bars them, each for three sides: inside a procedure, into a callee, out of one.
PLAIN, ONLY_CC1, PSEUDO, EXCLUSIVE, EXCLUSIVE_PSEUDO, BY_OBJECT = range(6)
INSIDE, INTO, OUT_OF = range(3)


def _bit(rule: int, side: int) -> int:
    return 1 << (FIRST + 3 * rule + side)


def _mask(rules: list[int], sides: list[int]) -> int:
    return sum(_bit(r, s) for r in rules for s in sides)


_WAYS = f"(how & {SORTS})"
_IS_ROOT = f"(how & {ROOT}) <> 0"
#: Left by one sort of conditional arcs alone, a node does not enter the slice.
KEPT = f"({_IS_ROOT} or {_WAYS} not in (0, {CC1}, {CC2}))"


def _allowed(sides: list[int]) -> str:
    """Arcs into a node of the slice that its state lets pass, as bits."""
    conditional = f"(not {_IS_ROOT} and {_WAYS} <> 0 and {_WAYS} & ~{CC1 | CC2} = 0)"
    by_cd = f"(not {_IS_ROOT} and {_WAYS} & ~{CD} = 0)"
    by_other = f"(not {_IS_ROOT} and {_WAYS} & {OBJECT} = 0)"
    some = lambda stop, *rules: f"if({stop}, 0, {_mask(list(rules), sides)})"
    parts = [some(conditional, PLAIN, ONLY_CC1), some(f"{conditional} or {by_cd}", PSEUDO), some("false", EXCLUSIVE), some(by_cd, EXCLUSIVE_PSEUDO), some(f"{conditional} or {by_other}", BY_OBJECT)]
    return f"if({KEPT}, {' | '.join(parts)}, 0)"


def _into(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, src, sort, rule)`` of arcs that a pass may use, written where the nodes lie that they lead into."""
    marks = nodes.where("pseudo or object_stop").select("node", "pseudo", "object_stop").repartition("node").groupBy("node").agg(F.max("pseudo").alias("pseudo"), F.max("object_stop").alias("object_stop"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind, is_cd = F.col("kind"), F.col("kind") == "CD"
    sort = F.when(is_cd, CD).when(kind == "CC1", CC1).when(kind == "CC2", CC2).when(kind == "OBJECT_FLOW", OBJECT).otherwise(OTHER)
    side = F.when(F.col("is_inter_in"), INTO).when(F.col("is_inter_out"), OUT_OF).otherwise(INSIDE)
    usable = arcs.where("not (is_inter_in and is_inter_out)").select(F.col("dst").alias("node"), "src", sort.alias("sort"), side.alias("side"), (is_cd & yes(F.col("exclusive"))).alias("exclusive"))
    led = usable.repartition("node").join(marks, "node", "left")
    own, pseudo = F.col("exclusive"), yes(F.col("pseudo"))
    rule = (
        F.when(F.col("sort") == CD, F.when(own & pseudo, EXCLUSIVE_PSEUDO).when(own, EXCLUSIVE).when(pseudo, PSEUDO).otherwise(PLAIN))
        .when((F.col("sort") == OBJECT) & ~yes(F.col("object_stop")), BY_OBJECT)
        .when(F.col("sort") == CC1, ONLY_CC1)
        .otherwise(PLAIN)
    )
    return keep(led.select("node", "src", "sort", (rule * 3 + F.col("side")).alias("at")).selectExpr("node", "src", "sort", f"shiftleft(1, {FIRST} + at) as rule").sortWithinPartitions("node"))


def _met(go: DataFrame, n: int, arcs: DataFrame) -> DataFrame:
    """``(key, node, how)``: the sources of the arcs that ``n`` rows of ``go(key, node, go)`` follow, with their sorts; few arcs go to many such rows, few rows to the arcs."""
    if n > SMALL and go.agg(F.approx_count_distinct("node")).first()[0] <= SMALL:
        some = go.groupBy("node").agg(F.bit_or("go").alias("some"))
        few = checkpoint(arcs.join(F.broadcast(some), "node").where("some & rule <> 0").drop("some"))  # about SMALL nodes at most
        arcs = F.broadcast(few) if few.count() <= SMALL else arcs
    elif n <= SMALL:
        go = F.broadcast(go)
    return go.select(*STATE, "go").join(arcs, "node").where("go & rule <> 0").select("key", F.col("src").alias("node"), F.col("sort").alias("how"))


def exception_sensitive(criteria: DataFrame, arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(criterion_id, node_id)`` under the rules for exceptions and objects, for all of ``criteria(key, node)`` at once.

    ``arcs(src, dst, kind, is_inter_in, is_inter_out, exclusive)`` may repeat;
    ``nodes(node, pseudo, object_stop)`` names the nodes with a mark, others
    have none. Going from t back to s:

    * a plain control dependence into a pseudo-predicate is not followed if t
      was reached by such arcs alone and is no criterion;
    * from a t reached by conditional arcs alone only exclusive control
      dependences are followed, criteria exempt;
    * object flow is followed into criteria, into nodes reached by object flow
      and into marked nodes (``object_stop``) alone;
    * s enters the slice unless it was reached by CC1 alone or by CC2 alone;
    * at the end CC1 goes on through nodes reached by CC1 alone.

    Arcs are written once, where the nodes lie that they lead into. What is
    known is a number for each criterion and node and lies by both, arcs that
    were followed are not named one by one. A round looks only at nodes whose
    number has changed and moves their rows and what these reach, and adds to
    what is known without writing that again. Rules are tested on the state at a
    round's start, and only relax but for exempt nodes, so the result does not
    depend on any order.
    """
    arcs = _into(arcs, nodes)
    merged = lambda df: df.groupBy(*STATE).agg(F.bit_or("how").alias("how"))
    state, rounds = keep(criteria.select(*STATE).repartition(*STATE).distinct().withColumn("how", F.lit(ROOT))), 0

    def advance(touched: DataFrame, allowed: str) -> DataFrame | None:
        """Follow what ``touched(key, node, how)`` now lets pass: the nodes reached by it in a new way, none at the end."""
        nonlocal state, rounds
        go = touched.withColumn("go", F.expr(f"{allowed} & ~how")).where("go <> 0")
        n = go.count()
        if not n:
            return None
        add, old = merged(_met(go, n, arcs)).union(go.select(*STATE, F.col("go").alias("how"))), state
        if n <= SMALL:
            add = keep(add)
            if add.count() <= 2 * SMALL:
                old = state.join(F.broadcast(add.select(*STATE)), STATE, "left_semi")
        none = F.lit(0)
        both = old.select(*STATE, F.col("how").alias("old"), none.alias("how")).union(add.select(*STATE, none.alias("old"), "how"))
        both = both.groupBy(*STATE).agg(F.bit_or("old").alias("old"), F.bit_or("how").alias("how")).where("how & ~old <> 0")
        new = keep(both.select(*STATE, F.expr("how | old").alias("how"), F.expr(f"how & ~old & {SORTS} <> 0").alias("moved")))
        state, rounds = state.union(new.select(*STATE, "how")), rounds + 1
        if rounds % 8 == 0:
            state = keep(merged(state))
        return new.where("moved").select(*STATE, "how")

    for sides in ([INSIDE, INTO], [INSIDE, OUT_OF]):
        for allowed in (_allowed(sides), f"if({_WAYS} = {CC1}, {_mask([ONLY_CC1], sides)}, 0)"):
            touched = state = keep(merged(state))
            while touched is not None:
                touched = advance(touched, allowed)
    return merged(state).where(KEPT).select(F.col("key").alias("criterion_id"), F.col("node").alias("node_id"))
