"""Programs, criteria and graph tables: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: file#line or file#line:variables; a line has no leading zero.
CRITERION = r"^(.+\.java)#([1-9][0-9]*)(?::(.+))?$"


def source_files(spark: SparkSession, *places: str, pattern: str = "*.java") -> DataFrame:
    """``(file, text)`` of all files below ``places`` whose names match ``pattern``; folders are searched to any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(places))
    return found.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def source_lines(files: DataFrame) -> DataFrame:
    """``(file, line, text)``, lines from 1."""
    return files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "line_text")).select("file", (F.col("at") + 1).alias("line"), F.col("line_text").alias("text"))


def criteria(specs: DataFrame) -> DataFrame:
    """``(spec, file, line, variable)``: one row for each variable of ``specs(spec)``; none named: a null one. Malformed rows go."""
    part = lambda i: F.regexp_extract("spec", CRITERION, i)
    names = F.when(part(3) != "", F.split(part(3), ","))
    return specs.where(F.col("spec").rlike(CRITERION)).select("spec", part(1).alias("file"), part(2).cast("long").alias("line"), F.explode_outer(names).alias("variable"))


def locate(criteria: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(spec, node)``: nodes that begin on a criterion's line and act on its variable.

    ``nodes(node, file, line, name)``, a row for each name a node acts on. No
    variable: all nodes of the line. A name not found there is sought again as a field of ``this``.
    """
    there = criteria.join(nodes, ["file", "line"])
    plain = there.where(F.col("variable").isNull() | (F.col("variable") == F.col("name")))
    left = there.join(plain.select("spec", "variable").distinct(), ["spec", "variable"], "left_anti")
    field = left.where(F.col("name") == F.concat(F.lit("this."), F.col("variable")))
    return plain.select("spec", "node").union(field.select("spec", "node")).distinct()


def write_graph(nodes: DataFrame, arcs: DataFrame, folder: str) -> None:
    """Nodes and arcs as Parquet; arcs by kind, so that slicers read only the kinds they follow."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    arcs.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/arcs")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/arcs")
