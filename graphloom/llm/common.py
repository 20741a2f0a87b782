"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a task turns into Python objects at a time.
CHUNK_ROWS = 200
#: Keys that a join broadcasts at most because they are hot, and the rows from which a key can be hot.
HOT_KEYS, HOT_ROWS = 4096, 20_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset: a temporary folder on a local master, an error on a cluster, whose machines share none."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(f"-{purpose}")
    return folder


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, saved: bool = False) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each ``key`` and in ``weight`` about the rows of ``left`` that it meets.

    Keys that hold a share of all rows are broadcast, so that no task gets them
    whole: those with at least one part in HOT_KEYS of ``total``, no less than
    the sum of weights, hence HOT_KEYS rows at most. All other keys are
    shuffled. Both sides are read twice; ``saved`` says that the left one is
    checkpointed already. ``weight`` is dropped.
    """
    if total < HOT_ROWS:  # no key can be hot
        return left.join(right.drop(weight), key)
    left, right = left if saved else checkpoint(left), checkpoint(right)
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = right.where(F.col(weight) >= least).drop(weight), right.where(F.col(weight) < least).drop(weight)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")  # HOT_KEYS rows at most
    return left.join(F.broadcast(hot), key).union(rest.join(cold, key))


def map_chunks(df: DataFrame, start: Callable[[], Callable[..., Iterable[dict]]], schema: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Run a Python function over small chunks of the columns of ``df``.

    ``start`` runs once a task and returns a function that takes one list per
    column and yields dicts of column lists. Memory stays bounded by a chunk.
    """
    arrow = pa.schema([])
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for out in step(*[c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def prefixed(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], total_rows: int, bucket_rows: int = 4096) -> DataFrame:
    """Add for each ``name: value`` of ``values`` the sum of the value over the rows of the same ``keys`` that stand earlier by ``order``.

    ``order`` starts with a column of evenly spread longs (a hash). A key may
    hold most of the rows: its rows are dealt into buckets by the leading bits
    of that column and the buckets into groups, so sums come from three levels
    and each window sees about the cube root of a hot key's rows, or
    ``bucket_rows``. Keys are not null.
    """
    bits = max(0, (max(1, total_rows // bucket_rows) - 1).bit_length())
    lead = F.col(order[0]).bitwiseXOR(F.lit(-(1 << 63)))
    bucket = F.shiftrightunsigned(lead, 64 - bits) if bits else F.lit(0).cast("long")
    half = bits // 2
    df = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())}).withColumn("_bucket", bucket)
    sums = [F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(values))]
    earlier = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w, out: [F.coalesce(F.sum(f"_v{i}").over(w), F.lit(0)).alias(f"{out}{i}") for i in range(len(values))]
    buckets = df.groupBy(*keys, "_bucket").agg(*sums).withColumn("_group", F.shiftright("_bucket", half))
    groups = buckets.groupBy(*keys, "_group").agg(*sums)
    groups = groups.select(*keys, "_group", *before(earlier(keys, ["_group"]), "_g"))
    buckets = buckets.select(*keys, "_group", "_bucket", *before(earlier([*keys, "_group"], ["_bucket"]), "_b")).join(groups, [*keys, "_group"])
    buckets = buckets.select(*keys, "_bucket", *[(F.col(f"_g{i}") + F.col(f"_b{i}")).alias(f"_o{i}") for i in range(len(values))])
    inner = df.select(*df.columns, *before(earlier([*keys, "_bucket"], order), "_i"))
    joined = inner.join(buckets, [*keys, "_bucket"])
    return joined.withColumns({name: F.col(f"_o{i}") + F.col(f"_i{i}") for i, name in enumerate(values)}).drop("_bucket", *[f"_{c}{i}" for i in range(len(values)) for c in "vio"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; longs.

    Alternating large-star and small-star steps: every step is two partial
    aggregations and two joins, and leaves at most as many edges as before.
    Centres with many neighbours are joined apart. It ends when a step leaves
    the set of edges as it was. The component is the smallest node.
    """
    state = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = checkpoint(state.select(F.col("u").alias("node")).union(state.select("v")).distinct())
    size = state.count()
    while size:
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = skew_join(both, least, "u", "n", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = skew_join(large, smaller, "u", "n", 2 * size)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smaller.select("u", F.col("m").alias("v")))
        new = checkpoint(small.where("u <> v").distinct())
        now = new.count()
        same = now == size and new.join(state, ["u", "v"], "left_anti").isEmpty()
        state, size = new, now
        if same:
            break
    return nodes.join(state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
