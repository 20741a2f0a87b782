"""Post-dominance and control dependence of procedures."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import per_procedure


def predicates(arcs: DataFrame) -> DataFrame:
    """Nodes with more than one outgoing arc."""
    return arcs.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_id")


def pseudo_predicates(arcs: DataFrame) -> DataFrame:
    """Nodes with exactly one non-executable outgoing arc."""
    return arcs.groupBy(F.col("src").alias("node_id")).agg(F.count_if(F.col("kind") == "NONEXEC").alias("n")).where("n = 1").select("node_id")


def _post_dominators(nodes: list, successors: dict) -> tuple[list, dict]:
    """The nodes by bit, and for each node the bits of itself and of what post-dominates it.

    The largest solution of: a node's set is itself and what all its targets'
    sets share; an end's is itself. Nodes that reach no end keep all bits.
    """
    names = list(dict.fromkeys([*nodes, *(t for targets in successors.values() for t in targets)]))
    bit = {n: 1 << i for i, n in enumerate(names)}
    everything = (1 << len(names)) - 1
    before = defaultdict(list)
    for s, targets in successors.items():
        for t in targets:
            before[t].append(s)
    out = dict.fromkeys(names, everything)
    todo = [n for n in names if not successors.get(n)]
    waiting = set(todo)
    at = 0
    while at < len(todo):
        n = todo[at]
        at += 1
        waiting.discard(n)
        common = everything if successors.get(n) else 0
        for t in successors.get(n, ()):
            common &= out[t]
        new = common | bit[n]
        if new != out[n]:
            out[n] = new
            for p in before[n]:
                if p not in waiting:
                    waiting.add(p)
                    todo.append(p)
    return names, out


def _members(names: list, bits: int):
    while bits:
        low = bits & -bits
        yield names[low.bit_length() - 1]
        bits ^= low


def post_dominators(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(a, b)``: every way from ``a`` to an end passes ``b``, or ``a`` reaches no end without it; ``a`` itself left out."""

    def visit(proc, left, successors):
        known = left["node"]
        names, bits = _post_dominators(known, {s: [r.dst for r in rs] for s, rs in successors.items()})
        place = {n: i for i, n in enumerate(names)}
        for a in known:
            for b in _members(names, bits[a] & ~(1 << place[a])):
                yield a, b

    return per_procedure(nodes.select("proc", "node"), arcs.select("proc", "src", "dst"), "a long, b long", visit)


def _immediate(nodes: list, successors: dict) -> dict:
    """For each node that reaches an end, the nearest node that all its ways to an end pass, or None; ends first.

    Repeated meets up the tree found so far, targets before sources. Targets
    that reach no end have no say.
    """
    before, names = defaultdict(list), dict.fromkeys(nodes)
    for s, targets in successors.items():
        for t in targets:
            before[t].append(s)
            names[s] = names[t] = None
    ends = [n for n in names if not successors.get(n)]
    order, seen = [], set(ends)
    todo = [(n, iter(before[n])) for n in ends]
    while todo:
        n, rest = todo[-1]
        p = next((p for p in rest if p not in seen), None)
        if p is None:
            order.append(n)
            todo.pop()
        else:
            seen.add(p)
            todo.append((p, iter(before[p])))
    order.reverse()
    rank = {n: i for i, n in enumerate(order)} | {None: -1}
    up = dict.fromkeys(ends)

    def meet(a, b):
        while rank[a] != rank[b]:
            if rank[a] > rank[b]:
                a = up[a]
            else:
                b = up[b]
        return a

    changed = True
    while changed:
        changed = False
        for n in order:
            if successors.get(n):
                known = [t for t in successors[n] if t in up]
                new = known[0]
                for t in known[1:]:
                    new = meet(new, t)
                if n not in up or up[n] != new:
                    up[n], changed = new, True
    return {n: up[n] for n in order}


def immediate_post_dominators(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(proc, node, above, depth)``: the tree of nearest post-dominators, a row a node.

    ``above`` is null at a root, whose depth is 0. Nodes that reach no end have
    no row. A node's post-dominators are what stands above it.
    """
    kind = nodes.schema["node"].dataType.simpleString()

    def visit(proc, left, successors):
        tree = _immediate(left["node"], {s: [r.dst for r in rs] for s, rs in successors.items()})
        depth = {}
        for n in tree:
            way = [n]
            while way[-1] not in depth and tree[way[-1]] is not None:
                way.append(tree[way[-1]])
            at = depth.setdefault(way[-1], 0)
            for k, m in enumerate(reversed(way)):
                depth[m] = at + k
        for n, above in tree.items():
            yield proc, n, above, depth[n]

    return per_procedure(nodes.select("proc", "node"), arcs.select("proc", "src", "dst"), f"proc {nodes.schema['proc'].dataType.simpleString()}, node {kind}, above {kind}, depth int", visit)


def control_dependence(nodes: DataFrame, arcs: DataFrame, traverse_all: bool = True) -> DataFrame:
    """``(a, b)``: b post-dominates some but not all targets of a's arcs.

    With ``traverse_all`` off, paths take executable arcs alone while all arcs
    of ``a`` count, as for graphs with pseudo-predicates.
    """

    def visit(proc, left, successors):
        plain = {s: [r.dst for r in rs if traverse_all or r.kind == "EXEC"] for s, rs in successors.items()}
        names, bits = _post_dominators([*left["node"], *(r.dst for rs in successors.values() for r in rs)], plain)
        place = {n: i for i, n in enumerate(names)}
        for a, rs in successors.items():
            if len(rs) > 1:
                some, each = 0, -1
                for r in rs:
                    some |= bits[r.dst]
                    each &= bits[r.dst]
                for b in _members(names, some & ~each & ~(1 << place[a])):
                    yield a, b

    return per_procedure(nodes.select("proc", "node"), arcs.select("proc", "src", "dst", "kind"), "a long, b long", visit)
