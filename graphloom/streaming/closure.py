"""A closure kept up to date while arcs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fixpoint import checkpoint, reach


def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All batches written below ``folder``; none yet: an empty table."""
    try:
        return spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return like.limit(0)


def keep_closure(stream: DataFrame, seeds: DataFrame, folder: str) -> StreamingQuery:
    """Append to ``folder/reached`` what new arcs ``(src, dst)`` of a stream add to the closure of ``seeds(key, node)``.

    A batch starts from the reached sources of its own arcs, not from the
    seeds. Each batch has its own folder and replaces it when run again, so a
    lost driver or executor leaves no row twice. Read with recursive lookup.
    """
    spark = stream.sparkSession

    def batch(new: DataFrame, number: int) -> None:
        new = checkpoint(new.select("src", "dst").distinct())
        new.write.mode("overwrite").parquet(f"{folder}/arcs/batch-{number}")
        arcs = _read(spark, f"{folder}/arcs", new)
        first = seeds.select("key", "node").distinct()
        # What this batch wrote before a failure is not counted as known.
        known = _read(spark, f"{folder}/reached", first).where(~F.input_file_name().contains(f"/batch-{number}/"))
        all_known = checkpoint(known.union(first).distinct())
        touched = all_known.join(new, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct()
        added = reach(touched.join(all_known, ["key", "node"], "left_anti"), arcs).join(known, ["key", "node"], "left_anti")
        start = first.join(known, ["key", "node"], "left_anti")
        checkpoint(added.union(start).distinct()).write.mode("overwrite").parquet(f"{folder}/reached/batch-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
