"""Object trees of types: fields within fields, with a level for each type that a field may hold, to a bounded depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import checkpoint

#: Levels of types that a tree has at most.
LIMIT = 10


def is_type(segment: Column) -> Column:
    """Whether a path's segment is a type, not a field."""
    return segment.startswith("<")


def plain_path(path: Column) -> Column:
    """A path without its segments of types."""
    return F.filter(path, lambda x: ~is_type(x))


def type_templates(fields: DataFrame, subtypes: DataFrame, limit: int = LIMIT, types: DataFrame | None = None) -> DataFrame:
    """``(type, path, plain, depth)``: the members of each type's tree.

    ``fields(type, name, field_type)`` are all fields of a type, inherited ones
    too; ``field_type`` is null where no type of the program is meant.
    ``subtypes(type, subtype)`` holds what may stand for a type, itself too. A
    tree has a segment ``<T>`` for each subtype with fields, below it those
    fields, and below a field the tree of its type; ``limit`` bounds the number
    of type segments on a path, so types that hold themselves end there.
    ``plain`` is the path without types. ``types(type)`` restricts the roots.

    A type's members are found once for all roots: each level joins the fields
    of the types that stand at the level before, so a round's work is the size
    of the level it makes.
    """
    fields = checkpoint(fields.where("type is not null and name is not null").select("type", "name", "field_type").dropDuplicates(["type", "name"]))
    full = fields.select(F.col("type").alias("subtype")).distinct()
    subs = checkpoint(subtypes.select("type", "subtype").distinct().join(full, "subtype").select(F.col("type").alias("at"), "subtype"))
    below = checkpoint(subs.join(fields.withColumnRenamed("type", "subtype"), "subtype").select("at", "subtype", "name", "field_type"))
    roots = (types if types is not None else subtypes).select("type").distinct()
    level = roots.select("type", F.array().cast("array<string>").alias("path"), F.col("type").alias("at"))
    out, depth = None, 0
    while depth < limit:
        depth += 1
        segment = F.concat(F.lit("<"), F.col("subtype"), F.lit(">"))
        kinds = level.join(subs, "at").select("type", F.concat("path", F.array(segment)).alias("path"))
        members = checkpoint(level.join(below, "at").select("type", F.concat("path", F.array(segment, F.col("name"))).alias("path"), F.col("field_type").alias("at")))
        here = kinds.union(members.select("type", "path")).withColumn("depth", F.lit(depth))
        out = here if out is None else out.union(here)
        level = members.where("at is not null")
        if level.isEmpty():
            break
    if out is None:
        out = level.select("type", "path", F.lit(0).alias("depth")).limit(0)
    return out.select("type", "path", plain_path(F.col("path")).alias("plain"), "depth")


def lookup(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(type, wanted, path)``: members of a type's tree that a path without types, ``wanted(type, path)``, means: all that are the same but for segments of types."""
    named = templates.where(F.size("path") > 0).where(~is_type(F.element_at("path", -1)))
    key = F.concat_ws(".", "plain")
    asked = wanted.select("type", F.col("path").alias("wanted"), F.concat_ws(".", plain_path(F.col("path"))).alias("_key")).distinct()
    return named.withColumn("_key", key).join(asked, ["type", "_key"]).select("type", "wanted", "path")


def has_member(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(type, wanted)`` that :func:`lookup` finds at least once."""
    return lookup(templates, wanted).select("type", "wanted").distinct()
