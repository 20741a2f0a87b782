"""What statements declare, define and use, from tables of their expressions."""

from __future__ import annotations

from collections import defaultdict
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import keep, per_procedure

OUTPUT, EXCEPTION = "-output-", "-activeException-"
SCOPE_IN, ARG_IN, THIS = "-scope-in-", "-arg-in-", "this"
#: Operations of the marks between which a call's actions stand.
ENTER, EXIT = "ENTER", "EXIT"
#: A slot after all children of an expression; what ends a child of a call comes after all of the child, whose last slot is _LAST + 1.
_LAST = 1 << 30
#: How a child is visited, by kind of its parent and its own position: ``(slot, op, optional)`` for each visit. Slots order what one
#: expression does; an op of None is that of the parent's visit.
VISITS: dict[tuple[str, int], list[tuple[int, str | None, bool]]] = {
    ("assign", 1): [(2, "DEF", False)],
    ("assign", 2): [(0, "USE", False)],
    ("assign_op", 1): [(1, "USE", False), (2, "DEF", False)],
    ("assign_op", 2): [(0, "USE", False)],
    ("pre", 1): [(0, "USE", False), (1, "DEF", False), (2, "USE", False)],
    ("post", 1): [(0, "USE", False), (1, "DEF", False)],
    ("array", 1): [(0, None, False)],
    ("array", 2): [(1, "USE", False)],
    ("inner", 1): [(0, None, False)],
    ("choice", 2): [(2, "USE", True)],
    ("choice", 3): [(3, "USE", True)],
    ("logic", 2): [(2, "USE", True)],
    ("foreach", 1): [(0, "USE", False)],
}


def field_chains(expressions: DataFrame) -> DataFrame:
    """``(expr, name)``: the whole name of each ``field`` expression that is a chain of fields from a name or ``this``, parentheses and casts aside.

    Any other chain (of what a call returns, of an array's element) has no row.
    A task reads its statements one after another.
    """

    def visit(node, left, kids):
        for rows in list(kids.values()):
            for x in rows:
                if (name := _chain(x, kids)) is not None:
                    yield x.dst, name

    rows = _statements(expressions)
    return per_procedure(_no_calls(rows), rows, "expr string, name string", visit)


def _statements(expressions: DataFrame) -> DataFrame:
    """``expressions`` as :func:`per_procedure` takes arcs: from parent to child, by statement."""
    text = lambda c, to: F.col(c).cast("string").alias(to)
    return expressions.select(text("node", "proc"), text("parent", "src"), text("expr", "dst"), F.col("pos").cast("int").alias("pos"), text("kind", "kind"), text("name", "name"))


#: What is known of a call, and what is inserted for it.
_LINK, _NEW = "struct<form:string,returns:boolean,alone:boolean,params:array<string>>", "struct<prepend:boolean,ord:int,real:string,var:string,op:string,optional:boolean>"


def _no_calls(rows: DataFrame) -> DataFrame:
    return rows.select("proc", F.col("dst").alias("node"), F.lit(None).cast(_LINK).alias("link"), F.lit(None).cast(_NEW).alias("new")).limit(0)


def _below(x, kids):
    """What stands under an expression; those under None are a statement's own."""
    return kids.get(x.dst, ()) if x.dst is not None else ()


def _chain(x, kids) -> str | None:
    """The whole name of an expression, if it is a field in a chain from a name or ``this``."""
    if x.kind != "field" or x.dst is None:
        return None
    tail = [x.name]
    while (x := next((c for c in _below(x, kids) if c.pos == 1 and c.kind in ("field", "inner", "name", "this") and c.dst is not None), None)) is not None:
        if x.kind in ("name", "this"):
            said = lambda names: ".".join(n for n in names if n is not None)
            return said([THIS if x.kind == "this" else x.name, said(reversed(tail))])
        if x.kind == "field":
            tail.append(x.name)
    return None


def expression_actions(expressions: DataFrame) -> DataFrame:
    """``(node, expr, var, op, optional, pos)``: the actions of each node in the order in which they happen, ``pos`` from 1.

    ``expressions(node, expr, parent, pos, kind, name)``: ``expr`` is unique over
    all nodes, ``parent`` null for a node's own expressions, and ``pos`` numbers
    what stands under one parent from 1. Kinds, with their children in order:

    * ``name``: the variable ``name``; ``inner``: what is in parentheses or cast
    * ``array``: array, index. As a target it defines the array and uses the index
    * ``assign``, ``assign_op``: target, value. The value comes first; a compound one uses its target as well
    * ``pre``, ``post``: the target of ``++`` or ``--``
    * ``choice``: condition and two branches; ``logic``: both sides of ``&&`` or ``||``. Branches and right sides are optional
    * ``declare``: the initial value, if any, of the variable ``name``; ``foreach``: what it runs over; ``parameter`` (of a catch too): none
    * ``return``, ``throw``: the value, if any, for OUTPUT or EXCEPTION
    * ``this``; ``field``: the field ``name`` of what it stands on. A chain from a name or ``this`` is one dotted variable

    Any other kind uses its children in order. Declarations and what comes with
    them are never optional. A task walks its statements one after another, from
    rows that lie by statement; a statement is bounded by the size of its source.
    """
    rows = keep(_statements(expressions).repartition("proc"))
    return _acted(rows, _no_calls(rows)).drop("real")


def call_actions(expressions: DataFrame, calls: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """``(node, expr, real, var, op, optional, pos)``: :func:`expression_actions` with what linked calls add.

    ``calls(expr, form, returns, alone, params)`` has a row for each expression
    of kind ``call`` whose callable is known; ``form`` is 'method', 'static',
    'new' or 'construct' (an explicit constructor call), ``returns`` says
    whether it has a value, ``alone`` whether it is a statement by itself, and
    ``params`` names the parameters, the last one again for further arguments. A
    call's scope is its child at ``pos`` 0, its arguments come from 1.

    Between ENTER and EXIT stand, in this order: a method's scope (``this``
    where there is none) and the definition of SCOPE_IN, each argument and the
    definition of ARG_IN, the definition of OUTPUT and, unless the call is
    alone, its use. A 'construct' declares ``this`` first and defines it after
    EXIT. ``real`` is the node that an action belongs to when calls get nodes of
    their own: ``call:this``, ``call:parameter`` or ``call:return``, the
    innermost one, null for the statement's node itself. Calls without a row are
    plain: their children are used. ``added`` is inserted on the way, as
    :func:`insert_for_calls` does with actions that are there already.

    Where ``calls`` and ``added`` have a column ``node`` too, their statements
    need not be looked up. Rows that lie by ``node`` are not moved, and none are written.
    """
    rows = _statements(expressions)
    held = lambda df: (df if "node" in df.columns else df.join(rows.where("kind = 'call'").select(F.col("proc").alias("node"), F.col("dst").alias("expr")).distinct(), "expr")).where("expr is not null")
    row = lambda df, link, new: df.select(F.col("node").cast("string").alias("proc"), F.col("expr").cast("string").alias("node"), link.cast(_LINK).alias("link"), new.cast(_NEW).alias("new"))
    known = row(held(calls), F.struct("form", "returns", "alone", "params"), F.lit(None))
    if added is not None:
        known = known.union(row(held(added.withColumnRenamed("call", "expr")), F.lit(None), F.struct("prepend", F.col("ord").cast("int").alias("ord"), "real", "var", "op", "optional")))
    return _acted(rows, known)


def _acted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``(node, expr, real, var, op, optional, pos)`` of :func:`_statements` and what is ``known(proc, node, link, new)`` of their calls."""

    def visit(node, left, kids):
        links, new = {}, defaultdict(list)
        for e, link, more in zip(left["node"], left["link"], left["new"], strict=True):
            if more is not None:
                new[e].append(more)
            elif link["form"] is not None:
                links.setdefault(e, link)
        did = sorted(_walk(kids, links, new), key=itemgetter(0))
        for i, (_, *action) in enumerate(did, 1):
            yield node, *action, i

    return per_procedure(known, rows, "node string, expr string, real string, var string, op string, optional boolean, pos int", visit, lying=True)


def _walk(kids, links, new):
    """``(place, expr, real, var, op, optional)`` of one statement, in any order: expressions by parent, what is known of calls and inserted for them by expression. A place has a slot for each level."""
    slot = lambda pos: float("-inf") if pos is None else pos
    todo = [(x, (slot(x.pos),), "USE", False, None) for x in kids.get(None, ())]
    while todo:
        x, at, op, optional, real = todo.pop()
        e, kind, name, chain = x.dst, x.kind, x.name, _chain(x, kids)
        if chain is not None:  # what it is made of is not visited by itself
            yield at, e, real, chain, op, optional
            continue
        if kind in ("this", "super"):
            kind, name = "name", kind
        if kind == "name":
            yield at, e, real, name, op, optional
        below, link = _below(x, kids), links.get(e) if kind == "call" else None
        own = lambda end: None if end is None else f"{e}:{end}"  # noqa: B023, E731
        for declared, declare, define in (("declare", 0, None), ("foreach", 1, 2), ("parameter", 0, 1)):
            if kind == declared:
                yield (*at, declare), e, real, name, "DEC", False
                if define is not None:
                    yield (*at, define), e, real, name, "DEF", False
        if link:
            yield (*at, -3), e, None, e, ENTER, False
            yield (*at, _LAST), e, None, e, EXIT, False
            for more in new.get(e, ()):
                if more["prepend"] is not None:
                    yield (*at, -3 if more["prepend"] else _LAST - 0.5, slot(more["ord"])), e, more["real"], more["var"], more["op"], more["optional"]
            if link["form"] == "construct":
                yield (*at, -2), e, real, THIS, "DEC", False
                yield (*at, _LAST + 1), e, real, THIS, "DEF", False
            if link["form"] == "method":
                if not any(c.pos == 0 for c in below):
                    yield (*at, 0), e, own(THIS), THIS, op, optional
                yield (*at, 0, _LAST + 2), e, own(THIS), SCOPE_IN, "DEF", False
            if link["returns"]:
                yield (*at, _LAST - 2), e, own("return"), OUTPUT, "DEF", False
                if link["alone"] is False:
                    yield (*at, _LAST - 1), e, None, OUTPUT, "USE", False
        for c in below:
            if c.pos == 1 and kind in ("declare", "return", "throw"):
                yield (*at, 2), e, real, {"declare": name, "return": OUTPUT, "throw": EXCEPTION}[kind], "DEF", False
            inner = real
            if link:
                params, n = link["params"] or [], c.pos or 0
                named = [p for p in (*params[max(n - 1, 0) : n], *params[-1:], None if c.pos is None else str(c.pos)) if p is not None]
                param = named[0] if named else None
                inner = own(THIS if c.pos == 0 else param)
                if n > 0:
                    yield (*at, n, _LAST + 2), e, own(param), ARG_IN, "DEF", False
            for place, how, maybe in VISITS.get((kind, c.pos), ((slot(c.pos), "USE", False),)):
                todo.append((c, (*at, place), how or op, optional or maybe, inner))


def _renumbered(own: DataFrame, added: DataFrame) -> DataFrame:
    """Both tables of actions, each with a ``place``, in one numbering a node."""
    columns = ["node", "expr", "real", "var", "op", "optional"]
    every = own.select(*columns, "place").unionByName(added.select(*columns, "place"))
    return every.select(*columns, F.row_number().over(Window.partitionBy("node").orderBy("place")).alias("pos"))


def insert_for_calls(actions: DataFrame, added: DataFrame) -> DataFrame:
    """``actions`` of :func:`call_actions` with those of ``added(call, prepend, ord, real, var, op, optional)`` right after the call's ENTER or right before its EXIT, in the order of ``ord``. Calls that no node holds add nothing."""
    place = lambda side, ord_: F.struct(F.col("pos").alias("a"), side.cast("int").alias("b"), ord_.cast("int").alias("c"))
    marks = actions.where(F.col("op").isin(ENTER, EXIT)).select("node", F.col("expr").alias("call"), (F.col("op") == ENTER).alias("prepend"), "pos")
    new = added.join(marks, ["call", "prepend"]).withColumn("place", place(F.when(F.col("prepend"), 1).otherwise(-1), F.col("ord"))).withColumn("expr", F.col("call"))
    return _renumbered(actions.withColumn("place", place(F.lit(0), F.lit(0))), new)


def insert_after_real(actions: DataFrame, added: DataFrame) -> DataFrame:
    """``actions`` with those of ``added(call, ord, real, var, op, optional)`` after the first unbroken run of actions of the same ``real`` node, or, where there is none, right after the call's ENTER."""
    place = lambda side, ord_: F.struct(F.col("pos").alias("a"), side.cast("int").alias("b"), ord_.cast("int").alias("c"))
    by = Window.partitionBy("node").orderBy("pos")
    ends = actions.withColumn("_next", F.lead("real").over(by)).where(F.col("real").isNotNull() & ~F.col("real").eqNullSafe(F.col("_next")))
    ends = ends.groupBy("node", "real").agg(F.min("pos").alias("end"))
    enters = actions.where(F.col("op") == ENTER).select("node", F.col("expr").alias("call"), F.col("pos").alias("enter"))
    new = added.join(enters, "call").join(ends, ["node", "real"], "left").withColumn("pos", F.coalesce("end", "enter"))
    return _renumbered(actions.withColumn("place", place(F.lit(0), F.lit(0))), new.withColumn("place", place(F.lit(1), F.col("ord"))).withColumn("expr", F.col("call")))


def call_nodes(actions: DataFrame) -> DataFrame:
    """``(node, parent, kind)`` of the nodes that calls get: CALL under the statement that holds it, ACTUAL_IN and RETURN under their call."""
    node = lambda met, name, parent, kind: F.when(met, F.struct(F.col(name).alias("node"), parent.alias("parent"), kind.alias("kind")))
    entered = node(F.col("op") == ENTER, "expr", F.col("node"), F.lit("CALL"))
    real = node(F.col("real").isNotNull(), "real", F.regexp_extract("real", r"^(.*):[^:]*$", 1), F.when(F.endswith("real", F.lit(":return")), "RETURN").otherwise("ACTUAL_IN"))
    # Actions are read once.
    return actions.select(F.explode(F.filter(F.array(entered, real), lambda x: x.isNotNull())).alias("x")).select("x.*").distinct()
