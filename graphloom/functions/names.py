"""Columns over names, member paths and arc kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of arc kinds in drawings.
COLOURS = {"FLOW": "red", "DATA": "red", "OBJECT_FLOW": "red", "TOTAL_DEF": "pink", "CC1": "orange", "CC2": "green", "SUMMARY": "#a01210"}


def root(name: Column) -> Column:
    """The part of a dotted name before its fields; all up to the last ``this`` belongs to it."""
    return F.regexp_extract(name, r"^((?:.*\bthis\b)|[^.]*)", 1)


def fields(name: Column) -> Column:
    """What follows the root, without the dot."""
    return F.regexp_replace(F.substr(name, F.length(root(name)) + 1), r"^\.", "")


def opens(path: Column, whole: Column) -> Column:
    """Whether the array ``path`` is an opening of ``whole``."""
    return F.slice(whole, 1, F.size(path)) == path


def colour(kind: Column, is_in: Column, is_out: Column) -> Column:
    """The colour of an arc; arcs between procedures by direction."""
    out = F.when(is_in, "darkgreen").when(is_out, "blue")
    for k, c in COLOURS.items():
        out = out.when(kind == k, c)
    return out.otherwise("black")


def default_value(type_name: Column) -> Column:
    """What a field of a type holds before it is set, as source text."""
    return F.when(type_name == "boolean", "false").when(type_name.isin("byte", "short", "int", "long", "float", "double", "char"), "0").otherwise("null")
