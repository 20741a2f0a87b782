"""Selections, lookups and classes of nodes and arcs; object trees; rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTO, OUT_OF = ("CALL", "PARAM_IN"), ("RETURN", "PARAM_OUT")


def classified(arcs: DataFrame) -> DataFrame:
    """Arcs with the booleans that slicers filter by."""
    return arcs.select("src", "dst", "kind", F.col("kind").isin(*INTO).alias("is_inter_in"), F.col("kind").isin(*OUT_OF).alias("is_inter_out"))


def tree_paths(segments: Column) -> Column:
    """All openings of a path, one for each node of its branch."""
    return F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))


def leaves(paths: DataFrame) -> DataFrame:
    """Paths that no other path goes on from; ``(tree, path)``."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    inner = paths.where(F.col("path").contains("/")).select("tree", parent.alias("path")).distinct()
    return paths.join(inner, ["tree", "path"], "left_anti")


def dot_lines(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One line of a DOT file for each node and arc."""
    colour = F.when(F.col("is_inter_in"), "darkgreen").when(F.col("is_inter_out"), "blue").when(F.col("kind") == "DATA", "red").otherwise("black")
    name = nodes.select(F.format_string('"%s" [label="%s"];', "node_id", "label").alias("line"))
    return name.union(arcs.select(F.format_string('"%s" -> "%s" [color=%s];', "src", "dst", colour).alias("line")))


def by_key(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(key, node_id)``: the node of each of ``keys(key)``; of several real ones before ``synthetic`` ones, then the smallest id. ``nodes(key, node_id, synthetic)``."""
    return keys.distinct().join(nodes, "key").groupBy("key").agg(F.min_by("node_id", F.struct("synthetic", "node_id")).alias("node_id"))


def inout_direction(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """``(src, dst, is_in, is_out)`` of arcs between parameters that go both ways.

    ``roots(node, root_kind)`` gives for every node, members included, the kind
    of the tree it belongs to: into a callee from ACTUAL_IN to FORMAL_IN, out of
    it from FORMAL_OUT to ACTUAL_OUT or from OUTPUT to CALL_RETURN.
    """
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root_kind").alias(f"{c}_kind"))
    both = arcs.select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst")
    a, b = F.col("src_kind"), F.col("dst_kind")
    out = ((a == "FORMAL_OUT") & (b == "ACTUAL_OUT")) | ((a == "OUTPUT") & (b == "CALL_RETURN"))
    return both.select("src", "dst", ((a == "ACTUAL_IN") & (b == "FORMAL_IN")).alias("is_in"), out.alias("is_out"))


def equal_trees(paths: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of neighbours, by name, among trees ``(tree, path)`` that have the same paths. Trees are compared by the number and the hashes of their paths, then path by path."""
    p = paths.select("tree", "path").distinct()
    form = p.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path")).alias("x"), F.sum(F.xxhash64("path") % 1_000_003).alias("s"))
    w = Window.partitionBy("n", "x", "s").orderBy("tree")
    pairs = form.withColumn("b", F.lead("tree").over(w)).where("b is not null").select(F.col("tree").alias("a"), "b", "n")
    shared = pairs.join(p.withColumnRenamed("tree", "a"), "a").join(p.withColumnRenamed("tree", "b"), ["b", "path"]).groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("m"))
    return shared.where("m = n").select("a", "b")


def text_lines(nodes: DataFrame) -> DataFrame:
    """One line of a text dump for each node, in the order of their ids."""
    return nodes.orderBy("node_id").select(F.format_string("%s: %s", "node_id", "label").alias("line"))


def class_dot_lines(arcs: DataFrame) -> DataFrame:
    """One line of a DOT file for each arc of a class graph; members dashed."""
    style = F.when(F.col("kind") == "MEMBER", "dashed").otherwise("solid")
    return arcs.select(F.format_string('"%s" -> "%s" [style=%s];', "src", "dst", style).alias("line"))
