"""Type hierarchies: closures, nearest definitions and shadowing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import checkpoint


def ancestors(types: DataFrame, extends: DataFrame) -> DataFrame:
    """``(type, ancestor, depth)``, each type its own ancestor at depth 0, others at their least depth. ``extends(child, parent)`` may branch, meet again and even turn in a circle."""
    extends = checkpoint(extends.select("child", "parent").distinct())
    out = delta = checkpoint(types.select("type", F.col("type").alias("ancestor")).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        step = delta.join(extends, F.col("ancestor") == F.col("child")).select("type", F.col("parent").alias("ancestor")).distinct()
        delta = checkpoint(step.join(out, ["type", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if delta.isEmpty():
            return out
        out = out.union(delta)
        if depth % 8 == 0:
            out = checkpoint(out)


def nearest_member(closure: DataFrame, members: DataFrame) -> DataFrame:
    """``(type, name, owner)``: for each type and member name the nearest ancestor that has it; own ones shadow inherited ones, and of several as near the first by name counts."""
    found = closure.join(members, F.col("ancestor") == F.col("owner"))
    return found.groupBy("type", "name").agg(F.min_by("owner", F.struct("depth", "owner")).alias("owner"))


def polymorphic_targets(calls: DataFrame, closure: DataFrame, members: DataFrame) -> DataFrame:
    """``(call_id, target)``: a call on a static type may run the nearest member of each subtype."""
    nearest = nearest_member(closure, members)
    subtypes = closure.select(F.col("ancestor").alias("static_type"), "type")
    return calls.join(subtypes, "static_type").join(nearest, ["type", "name"]).select("call_id", F.concat_ws(".", "owner", "name").alias("target")).distinct()


def class_arcs(types: DataFrame, extends: DataFrame, members: DataFrame) -> DataFrame:
    """``(src, dst, kind)``: EXTENDS from a type to a parent that is itself in the graph, MEMBER from an owner in the graph to ``owner.name``."""
    known = types.select("type").distinct()
    up = extends.join(known, F.col("child") == F.col("type"), "left_semi").join(known, F.col("parent") == F.col("type"), "left_semi")
    own = members.join(known, F.col("owner") == F.col("type"), "left_semi")
    return up.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("EXTENDS").alias("kind")).union(own.select("owner", F.concat_ws(".", "owner", "name"), F.lit("MEMBER"))).distinct()


def parents(types: DataFrame, extends: DataFrame) -> DataFrame:
    """``(type, parent)``: the first parent by name that is in the graph; types without one have no row."""
    known = types.select("type").distinct()
    up = extends.join(known, F.col("parent") == F.col("type"), "left_semi").withColumnRenamed("child", "type")
    return up.join(known, "type", "left_semi").groupBy("type").agg(F.min("parent").alias("parent"))


def overridden(closure: DataFrame, members: DataFrame) -> DataFrame:
    """``(owner, name, overrider)``: for each member those of the same name in its owner's subtypes, its own among them."""
    below = closure.select(F.col("ancestor").alias("owner"), F.col("type").alias("overrider"))
    return members.join(below, "owner").join(members.select(F.col("owner").alias("overrider"), "name"), ["overrider", "name"], "left_semi").select("owner", "name", "overrider").distinct()


def visible_fields(closure: DataFrame, fields: DataFrame) -> DataFrame:
    """``(type, name, owner, inherited, linked)`` of every field that a type has, own ones shadowing inherited ones.

    ``fields(owner, name, field_type)``; ``linked`` is the field's type where
    that is in the graph.
    """
    near = nearest_member(closure, fields.select("owner", "name").distinct())
    known = closure.select(F.col("type").alias("linked")).distinct()
    typed = near.join(fields, ["owner", "name"]).join(known, F.col("field_type") == F.col("linked"), "left")
    return typed.select("type", "name", "owner", (F.col("owner") != F.col("type")).alias("inherited"), "linked")


def dynamic_types(actions: DataFrame, closure: DataFrame) -> DataFrame:
    """``(action, type)``: the static type of ``actions(action, static_type)`` and every subtype in the graph; a type beyond the graph stays alone."""
    below = closure.select(F.col("ancestor").alias("static_type"), "type")
    return actions.join(below, "static_type", "left").select("action", F.coalesce("type", "static_type").alias("type")).distinct()


def down_casts(casts: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows of ``casts(cast, cast_type, value_type)`` whose cast type has the value's type among its proper ancestors."""
    up = closure.where("depth > 0").select(F.col("type").alias("cast_type"), F.col("ancestor").alias("value_type"))
    return casts.join(up, ["cast_type", "value_type"], "left_semi").select("cast")


def call_candidates(calls: DataFrame, closure: DataFrame, members: DataFrame, up: DataFrame) -> DataFrame:
    """``(call_id, target)`` of ``calls(call_id, scope, inside, static_type, name)`` by what stands before the name.

    ``scope``: 'none', the nearest member of the type ``inside`` and all that
    override it; 'this', any subtype of ``inside``; 'outer' and 'value', any
    subtype of ``static_type``; 'super', the parent of ``inside`` alone, from
    ``up(type, parent)``. Each type stands for its nearest member of the name.
    """
    nearest = nearest_member(closure, members)
    # Without a scope: the member that the caller sees says from which type on overriders count.
    seen = calls.where("scope = 'none'").join(nearest.withColumnRenamed("type", "inside"), ["inside", "name"]).select("call_id", "owner", "name")
    free = seen.join(overridden(closure, members), ["owner", "name"]).select("call_id", F.col("overrider").alias("owner"), "name")
    below = closure.select(F.col("ancestor").alias("from"), "type")
    origin = F.when(F.col("scope") == "this", F.col("inside")).when(F.col("scope").isin("outer", "value"), F.col("static_type"))
    wide = calls.withColumn("from", origin).join(below, "from").select("call_id", "type", "name")
    above = calls.where("scope = 'super'").join(up.withColumnRenamed("type", "inside"), "inside").select("call_id", F.col("parent").alias("type"), "name")
    bound = wide.union(above).join(nearest, ["type", "name"]).select("call_id", "owner", "name")
    return free.union(bound).select("call_id", F.concat_ws(".", "owner", "name").alias("target")).distinct()


def single_targets(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """``(call_id, target)`` of static and constructor calls ``(call_id, target)`` whose declaration is in the program, ``declared(target)``."""
    return calls.join(declared.select("target").distinct(), "target", "left_semi").select("call_id", "target")


def implicit_constructors(types: DataFrame, constructors: DataFrame) -> DataFrame:
    """``(type, constructor)``: a constructor for each type that declares none; where ``types`` has a ``kind``, for classes and enums alone."""
    able = types.where(F.col("kind").isin("class", "enum")) if "kind" in types.columns else types
    return able.select("type").distinct().join(constructors.select("type"), "type", "left_anti").select("type", F.concat(F.lit("new "), "type").alias("constructor"))
