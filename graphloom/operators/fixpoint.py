"""Closures over arcs: a semi-naive driver for whole programs, and one task per procedure for local ones."""

from __future__ import annotations

import tempfile
from collections import defaultdict, namedtuple
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows of a round's news up to which they are broadcast instead of the tables they meet being shuffled: two ids each, some ten MB.
SMALL = 100_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``. Where that is unset: a temporary folder on a local master, an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoint"))
    return df.checkpoint()


#: Settings under which :func:`keep` plans: a plan that may still change says nothing of where its rows lie, and rows that lie by some of a
#: join's columns need not be moved for the others. Sizes are guessed from before rows were exploded, so what a hint names alone is broadcast.
_SETTLED = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def keep(df: DataFrame) -> DataFrame:
    """:func:`checkpoint` of a frame that lies by some columns, as after ``repartition``: joins within :func:`keep` and windows over these columns leave its rows where they are. The session's settings are as before afterwards."""
    conf = df.sparkSession.conf
    was = {k: conf.get(k) for k in _SETTLED}
    try:
        for k, v in _SETTLED.items():
            conf.set(k, v)
        return checkpoint(df)
    finally:
        for k, v in was.items():
            conf.set(k, v)


def news(step: DataFrame, n: int, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``step``, distinct and about ``n``, that are not in ``seen``. Few rows go to where ``seen`` lies; else both are shuffled."""
    if n > SMALL:
        return step.join(seen, key, "left_anti")
    known = seen.select(*key).join(F.broadcast(step.select(*key)), key, "left_semi")  # SMALL rows at most
    return step.join(known, key, "left_anti")


def by_source(arcs: DataFrame) -> DataFrame:
    """``arcs(src, ...)`` written where their sources lie, so that :func:`reach` need not move them again."""
    return keep(arcs.repartition("src"))


def reach(seeds: DataFrame, arcs: DataFrame, known: DataFrame | None = None, saved: bool = False) -> DataFrame:
    """All ``(key, node)`` that ``seeds(key, node)`` reach over ``arcs(src, dst)``, seeds included, and ``known``, which is not searched from.

    All keys advance together: a round joins only what the last one added.
    While that is little it is broadcast, so arcs and what is known stay where
    they are; much of it at few nodes meets the arcs of these alone. From the
    first round with much news on, arcs lie by their source and what is known
    by key and node, so that a round moves its own rows alone. What it
    finds at nodes that no key had before is new, so only the rest is held
    against what is known, at the same nodes. Arcs are made distinct and
    written once, unless they are ``saved``: all but distinct, and written by
    :func:`by_source`.
    """
    key = ["key", "node"]
    arcs = arcs.select("src", "dst") if saved else checkpoint(arcs.select("src", "dst").distinct())
    seen = seeds.select(*key).distinct()
    seen = delta = checkpoint(seen if known is None else seen.join(known, key, "left_anti"))
    if known is not None:
        seen = known.select(*key).union(delta)
    n, rounds, placed, met = delta.count(), 0, False, None
    total = n if known is None else n + known.count()
    while n:
        if n > SMALL and not placed:
            arcs, seen, placed = arcs if saved else by_source(arcs), keep(seen.repartition(*key)), True
        if n > SMALL:
            met = checkpoint(seen.select("node").distinct()) if met is None else met
            delta, met = _far(delta, arcs, seen, met)
        elif placed:
            met = None
            delta = keep(F.broadcast(delta).join(arcs, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct().join(seen, key, "left_anti"))
        else:
            step = F.broadcast(delta).join(arcs, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct()
            if total <= SMALL:
                delta = checkpoint(step.join(F.broadcast(seen), key, "left_anti"))  # SMALL rows at most
            else:
                step = checkpoint(step)
                delta = checkpoint(news(step, step.count(), seen, key))
        n = delta.count()
        total += n
        if n:
            seen, rounds = seen.union(delta), rounds + 1
            if rounds % 8 == 0:
                seen = keep(seen) if placed else checkpoint(seen)
    return seen


def _far(delta: DataFrame, arcs: DataFrame, seen: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round of :func:`reach` with much news: what ``delta`` adds to ``seen``, whose nodes are ``met``, and the nodes met after it. The rows added lie by key and node."""
    if delta.agg(F.approx_count_distinct("node")).first()[0] <= SMALL:
        few = checkpoint(arcs.join(F.broadcast(delta.select("node").distinct()), F.col("node") == F.col("src"), "left_semi"))  # about SMALL nodes at most
        n = few.count()
        if not n:
            return delta.limit(0), met
        arcs = F.broadcast(few) if n <= SMALL else arcs
    step = keep(delta.join(arcs, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct())
    to = checkpoint(step.select("node").distinct().join(met.withColumn("old", F.lit(True)), "node", "left"))
    again = to.where("old").select("node")
    n = again.count()
    if n:
        # SMALL nodes at most
        step = keep(step.join(seen.join(F.broadcast(again), "node", "left_semi") if n <= SMALL else seen, ["key", "node"], "left_anti"))
    return step, met.union(to.where("old is null").select("node"))


#: Arcs at the nodes of a round's news up to which :func:`reach_near` broadcasts them: two ids each, some fifty MB.
FEW = 500_000


def reach_near(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(key, node)``: what each of ``nodes(node)``, a key of its own, reaches over ``arcs(src, dst)``, as :func:`reach` says, where keys are many and reach little.

    All of a key lies in one task, and nodes lie with the arcs that leave them,
    so the first round is a join that moves and writes nothing. From then on
    arcs at the nodes of the last round's news are broadcast while they are
    few, and again nothing moves; many are met by moving the news there and back.
    """
    placed = lambda df, by: keep(df.repartition(by).sortWithinPartitions(by))
    arcs, own = placed(arcs.select("src", "dst"), "src"), keep(nodes.select("node").repartition("node").distinct().sortWithinPartitions("node"))
    first = own.select(F.col("node").alias("key"), "node")
    met = F.col("node") == F.col("src")
    # Found anew wherever it is read; rows may repeat where that does not matter. What a round adds is written.
    delta = first.join(arcs.hint("merge"), met).select("key", F.col("dst").alias("node")).where("not (key <=> node)")
    near, far = delta, []
    while True:
        at = arcs.join(keep(delta.select("node").distinct()).hint("merge"), met, "left_semi")
        n = at.count()
        if not n:
            break
        step = delta.join(F.broadcast(at) if n <= FEW else arcs, met).select("key", F.col("dst").alias("node")).where("not (key <=> node)")
        for known in (near, *far):  # a union would not lie by key
            step = step.join(known, ["key", "node"], "left_anti")
        delta = keep(step.distinct())
        if delta.isEmpty():
            break
        far.append(delta)
        if len(far) % 8 == 0:
            far = [keep(reduce(DataFrame.union, far).repartition("key"))]
    return reduce(DataFrame.union, [first, near.distinct(), *far])


def search(starts: DataFrame, arcs: DataFrame, walls: DataFrame, marks: DataFrame) -> DataFrame:
    """``(key, var, node)``: the marked nodes that searches visit.

    A search ``starts(proc, key, var, node)`` from its nodes and follows
    ``arcs(proc, src, dst)``, but not on from nodes that are a wall of its
    variable, ``walls(proc, node, var)``. ``marks(proc, node, var)`` name what is
    wanted, for one variable or, null, for all. Procedures of up to PROC_ARCS
    arcs are searched a task each; larger ones by joins over all tasks, a straight line a round.
    """
    arcs = arcs.select("proc", "src", "dst").distinct()
    sizes = arcs.groupBy("proc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PROC_ARCS).select("proc")
    large = checkpoint(sizes)
    if large.isEmpty():
        return _search_small(starts, arcs, walls, marks)
    # Outer joins: pushed below the callers' joins, semi and anti joins leave an invalid plan.
    part = lambda df, hot: df.join(large.withColumn("_hot", F.lit(True)), "proc", "left").where("_hot" if hot else "_hot is null").drop("_hot")
    few = _search_small(*[part(df, False) for df in (starts, arcs, walls, marks)])
    from .lines import search_lines

    return few.union(search_lines(*[checkpoint(part(df, True)) for df in (starts, arcs, walls, marks)]))


PROC_ARCS = 50_000


def _search_small(starts: DataFrame, arcs: DataFrame, walls: DataFrame, marks: DataFrame) -> DataFrame:
    keys = starts.schema["key"].dataType.simpleString()
    row = lambda df, role, k: df.select("proc", F.lit(role).alias("role"), F.col(k).alias("key") if k else F.lit(None).cast(keys).alias("key"), "node", "var")
    left = row(starts, "start", "key").union(row(walls, "wall", None)).union(row(marks, "mark", None))

    def visit(proc, left, successors):
        after = {n: [r.dst for r in rows] for n, rows in successors.items()}
        stops, wanted, begun = defaultdict(set), defaultdict(set), defaultdict(list)
        for role, k, n, var in zip(*[left[c] for c in ("role", "key", "node", "var")], strict=True):
            if role != "start":
                (stops if role == "wall" else wanted)[var].add(n)
            elif k is not None and var is not None:
                begun[k, var].append(n)
        for (k, var), todo in begun.items():
            stop, marked, every, seen = stops[var], wanted[var], wanted[None], set()
            while todo:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                if n in marked or n in every:
                    yield k, var, n
                if n not in stop:
                    todo += after.get(n, ())

    nodes = starts.schema["node"].dataType.simpleString()
    return per_procedure(left, arcs, f"key {keys}, var {starts.schema['var'].dataType.simpleString()}, node {nodes}", visit)


def _values(column: pa.Array) -> list:
    """``column.to_pylist()``, which takes long for each value; texts, whole numbers and booleans go by way of numpy."""
    if column.null_count == len(column):
        return [None] * len(column)
    plain = any(is_type(column.type) for is_type in (pa.types.is_string, pa.types.is_integer, pa.types.is_boolean))
    return column.to_pandas(integer_object_nulls=True).tolist() if plain else column.to_pylist()


def per_procedure(nodes: DataFrame, arcs: DataFrame, schema: str, visit, lying: bool = False) -> DataFrame:
    """Run ``visit(procedure, nodes, successors)`` once a procedure; it yields result rows.

    ``nodes(proc, node, ...)`` and ``arcs(proc, src, dst, ...)``; ``visit`` gets
    the nodes as lists by column, and the arcs by source. A procedure is one
    callable's graph, bounded by the size of its source; a task reads its
    procedures one after another, many in a batch. Frames that lie by ``proc``
    are not moved if they are said to be ``lying`` so.
    """
    node, arc = ([c for c in df.columns if c != "proc"] for df in (nodes, arcs))
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType) for c in names]
    rows = nodes.select("proc", F.lit(True), *node, *none(arcs, arc)).union(arcs.select("proc", F.lit(False), *none(nodes, node), *arc))
    rows = rows.toDF("proc", "is_node", *[f"node_{c}" for c in node], *[f"arc_{c}" for c in arc])
    types = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)

    # A window moves rows only where they do not lie by its keys, and leaves them sorted; a task does not look at their numbers.
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("proc").orderBy("is_node"))) if lying else rows.repartition("proc").sortWithinPartitions("proc")

    def run(batches):
        arc_row, last, left, after, found = namedtuple("Arc", arc), (), [], defaultdict(list), []

        def visited():
            columns = zip(*left, strict=True) if left else [()] * len(node)
            return visit(last[0], dict(zip(node, map(list, columns), strict=True)), after)

        def packed():
            columns = zip(*found, strict=True) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

        for batch in batches:
            for proc, is_node, *values in zip(*map(_values, batch.columns), strict=True):
                if (proc,) != last:
                    if last:
                        found += visited()
                    last, left, after = (proc,), [], defaultdict(list)
                if is_node:
                    left.append(values[: len(node)])
                else:
                    r = arc_row(*values[len(node) : len(node) + len(arc)])
                    after[r.src].append(r)
            yield packed()
            found = []
        if last:
            found += visited()
            yield packed()

    return placed.mapInArrow(run, schema)
