"""Where slices begin: units of criteria, nodes around a range of source, nodes of variables and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def units_of(criteria: DataFrame, files: DataFrame, types: DataFrame) -> DataFrame:
    """``(spec, unit)`` of ``criteria(spec, file, class)``: the units of the file, or else those that declare the class; without either the first.

    ``files(unit, path)`` with whole paths, ``types(unit, type)`` with whole names of the types at a unit's top.
    """
    by_path = criteria.where("file is not null").join(files, F.col("file") == F.col("path")).select("spec", "unit")
    by_class = criteria.where("file is null and class is not null").join(types, F.col("class") == F.col("type")).select("spec", "unit")
    first = files.agg(F.min("unit").alias("unit")).where("unit is not null").withColumn("_one", F.lit(1))
    bare = criteria.where("file is null and class is null").select("spec", F.lit(1).alias("_one")).join(first, "_one").select("spec", "unit")
    return by_path.union(by_class).union(bare).distinct()


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(key, node)``: for each range of source the smallest node around it.

    ``inner(key, unit, start, end)``, ``outer(node, unit, start, end)`` with whole
    numbers, both ends inside; of nodes as long the last to start, then the
    first by id. A node goes to the one or two buckets it touches of the least
    power of two that is not below its length; a range looks into one bucket a
    size that occurs in its unit, so only nodes near it are compared.
    """
    size = F.length(F.bin(F.col("end") - F.col("start")))
    bucket = lambda at, s: F.call_function("shiftright", at, s)
    nodes = outer.where("end >= start").withColumn("size", size)
    nodes = nodes.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("start"), F.col("size")), bucket(F.col("end"), F.col("size"))))))
    nodes = nodes.select("unit", "size", "bucket", "node", F.col("start").alias("from"), F.col("end").alias("to"))
    sizes = nodes.groupBy("unit").agg(F.collect_set("size").alias("sizes"))  # at most 64 a unit
    asked = inner.join(sizes, "unit").withColumn("size", F.explode("sizes")).withColumn("bucket", bucket(F.col("start"), F.col("size")))
    met = asked.join(nodes, ["unit", "size", "bucket"]).where("from <= start and to >= end")
    return met.groupBy("key").agg(F.min_by("node", F.struct(F.col("to") - F.col("from"), -F.col("from"), "node")).alias("node"))


def by_declaration(declared: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(key, vertex)``: the callable of each ``declared(key, type, signature)``: of ``vertices(vertex, type, signature)`` one of the whole type name, else all of the simple one."""
    simple = F.regexp_extract("type", r"([^.]*)$", 1)
    met = declared.withColumn("simple", simple).join(vertices.select("vertex", F.col("type").alias("_type"), "signature", simple.alias("simple")), ["simple", "signature"])
    exact = F.col("type") == F.col("_type")
    marked = met.withColumn("best", F.bool_or(exact).over(Window.partitionBy("key")))
    return marked.where(~F.col("best") | exact).select("key", "vertex").distinct()


def variable_nodes(wanted: DataFrame, actions: DataFrame, members: DataFrame) -> DataFrame:
    """``(spec, node)``: where a slice for a variable begins.

    ``wanted(spec, node, variable)`` with the statements of a criterion and all
    that hangs below them, ``actions(node, action, name, root)``, ``root`` null
    without a tree, ``members(action, path, node)`` with '/' between the parts of
    a path and types in angle brackets. An action of the name gives the root of
    its tree, or its node; one of the name before the fields gives the members
    that the fields lead to, whatever types stand between. No variable: every
    node. A criterion with nothing found is sought again as a field of ``this``.
    """
    every = wanted.where("variable is null").select("spec", "node")
    plain = F.array_join(F.filter(F.split("path", "/"), lambda x: ~x.startswith("<")), ".")
    typed = F.element_at(F.split("path", "/"), -1).startswith("<")
    leads = members.where(~typed).select("action", plain.alias("fields"), F.col("node").alias("member"))

    def found(w: DataFrame) -> DataFrame:
        met = w.join(actions, "node")
        whole = met.where(F.col("name") == F.col("variable")).select("spec", F.coalesce("root", "node").alias("node"))
        parts = met.where((F.col("name") != F.col("variable")) & F.col("variable").contains(".") & (F.col("name") == names.root(F.col("variable"))))
        return whole.union(parts.withColumn("fields", names.fields(F.col("variable"))).join(leads, ["action", "fields"]).select("spec", "member"))

    first = found(wanted.where("variable is not null"))
    left = wanted.where("variable is not null and not startswith(variable, 'this')").join(first.select("spec").distinct(), "spec", "left_anti")
    return every.union(first).union(found(left.withColumn("variable", F.concat(F.lit("this."), "variable")))).distinct()
