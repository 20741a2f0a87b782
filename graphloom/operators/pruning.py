"""From slices back to programs: which parts of a syntax tree stay, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import ancestors


def kept_nodes(tree: DataFrame, in_slice: DataFrame) -> DataFrame:
    """``(node)``: the nodes of a syntax tree that a slice keeps.

    ``tree(node, parent, by_content)``, ``in_slice(node)``. A node is kept if it
    is in the slice, or, where ``by_content`` is set, if it has kept content. A
    node that is dropped takes its content with it.
    """
    up = ancestors(tree.select(F.col("node").alias("type")), tree.where("parent is not null").select(F.col("node").alias("child"), "parent"))
    chosen = in_slice.select("node").distinct().join(tree.select("node"), "node", "left_semi")
    above = chosen.join(up, F.col("node") == F.col("type")).select("node", F.col("ancestor").alias("above"))
    dropped = tree.where("not by_content").select(F.col("node").alias("above")).join(chosen.select(F.col("node").alias("above")), "above", "left_anti")
    lost = above.join(dropped, "above", "left_semi").select("node").distinct()
    return above.join(lost, "node", "left_anti").select(F.col("above").alias("node")).distinct()


def sliced_text(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """``(file, text)``: the kept lines of each file in order. ``lines(file, line, text)``, ``kept(file, line)``.

    A file is one source text, so its lines fit in one row.
    """
    stay = lines.join(kept.select("file", "line").distinct(), ["file", "line"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return stay.groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


#: Opens a written file: what a slice is for and where it comes from.
HEADER = "/*\n\tPart of a program: what may affect %s in line %s of %s.\n\tTaken from %s\n*/\n"


def write_sources(texts: DataFrame, folder: str) -> None:
    """``texts(file, package, text, origin, line, variable)``, a row for each source file, as files below ``folder``.

    Each file's folder is ``package=<package>/name=<file>`` and holds one part
    with a header and the text as it stands. A null variable is 'anything'.
    """
    head = F.format_string(HEADER, F.coalesce("variable", F.lit("anything")), F.col("line").cast("string"), F.col("origin"), F.col("file"))
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    out = texts.select("package", name.alias("name"), F.concat(head, F.coalesce("text", F.lit(""))).alias("value"))
    out.write.mode("overwrite").partitionBy("package", "name").option("lineSep", "\n").text(folder)
