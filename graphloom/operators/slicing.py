"""Slices of many criteria at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import by_source, per_procedure, reach, reach_near


def _backward(arcs: DataFrame, *more: str) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more)


def passes(criteria: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, node)`` after the first pass, and after both, of ``criteria(key, node)``.

    The first pass leaves out arcs that come back out of callees, the second
    those that go into them; it starts from all the first has found. Only arcs
    that the first left out lead anywhere new, so the second begins with them.
    """
    arcs = by_source(_backward(arcs, "is_inter_in", "is_inter_out"))
    first = reach(criteria, arcs.where("not is_inter_out"), saved=True)
    out = arcs.where("is_inter_out and not is_inter_in").select("src", "dst").distinct()
    entered = first.join(out, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node"))
    return first, reach(entered, arcs.where("not is_inter_in"), first, saved=True)


def two_pass(criteria: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(criterion_id, node_id)``: what may affect each of ``criteria(key, node)``; see :func:`passes`."""
    return passes(criteria, arcs)[1].select(F.col("key").alias("criterion_id"), F.col("node").alias("node_id"))


def intra(criteria: DataFrame, arcs: DataFrame) -> DataFrame:
    """Slices that cross no arc between procedures, of ``criteria(key, node)`` or, each a key of its own, ``criteria(node)``. Such slices are small where procedures are."""
    own = _backward(arcs.where("not is_inter_in and not is_inter_out"))
    found = reach(criteria, by_source(own), saved=True) if "key" in criteria.columns else reach_near(criteria, own)
    return found.select(F.col("key").alias("criterion_id"), F.col("node").alias("node_id"))


def pseudo_predicate(criteria: DataFrame, arcs: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Slices in procedures that do not follow control dependences into a pseudo-predicate, unless it is the criterion.

    ``criteria(proc, node)``, ``arcs(proc, src, dst, kind)``.
    """
    marked = arcs.join(pseudo.select(F.col("node_id").alias("dst"), F.lit(True).alias("pseudo")), "dst", "left").select("proc", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.coalesce("pseudo", F.lit(False)) & (F.col("kind") == "CD")).alias("barred"))

    def visit(proc, left, into):
        for c in left["node"]:
            seen, todo = {c}, [c]
            while todo:
                t = todo.pop()
                for r in into.get(t, ()):
                    if r.dst not in seen and (t == c or not r.barred):
                        seen.add(r.dst)
                        todo.append(r.dst)
            for n in seen:
                yield c, n

    return per_procedure(criteria.select("proc", "node"), marked, "criterion_id long, node_id long", visit)


def without_objects(arcs: DataFrame) -> DataFrame:
    """The arcs of the variant that knows no objects: no object flow, no total definitions."""
    return arcs.where("kind not in ('OBJECT_FLOW', 'TOTAL_DEF')")


def without_conditions(arcs: DataFrame) -> DataFrame:
    """The arcs of the variant that knows no conditional control dependence."""
    return arcs.where("kind not in ('CC1', 'CC2')")
