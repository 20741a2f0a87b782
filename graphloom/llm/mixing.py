"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets come from water-filling over the sources. A source's documents stand
in a random order that a seed fixes, and the line of their words is cut into
blocks of equal size. Whole passes over a source and a part of one pass make up
its target exactly: its quota of blocks. A tree halves the output shards again
and again and splits the quotas of all sources between the halves by a
multivariate hypergeometric draw, so shards have equal numbers of blocks and
sources spread as if all blocks had been shuffled. By its quotas each shard
draws blocks from its own stretch of each source's permutation, disjoint from
all other shards, and shuffles them locally.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_chunks, prefixed, shared_folder, skew_join

SEED = 20_240_601
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 256
#: Output shards at least, and words of a shard at most.
SHARDS, SHARD_WORDS = 16, 1 << 24
#: Drawn blocks that a task makes about.
SLOT_ROWS = 100_000
#: Rounds of the swap-or-not permutation, and levels of the tree that a task goes down at a time.
ROUNDS, LEVELS = 12, 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Numpy draws exactly up to this population; beyond it the probabilities themselves are summed.
_MOST = 10**9 - 1


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, place, weight, target)`` from ``(source, source_size)``, a row per source; other columns pass.

    Target = min(CAP * size, level * weight), with the level at which the sum
    is SHARE of all sizes: sources above their cap are set to it and the rest
    reshared by weight until none is above. ``place`` counts sources by code
    point, null last; it is found from sorted partitions and their counts, and
    each round of resharing is one aggregation.
    """
    ordered = checkpoint(sizes.orderBy(F.col("source").asc_nulls_last()).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row per partition
    before, starts = 0, {}
    for r in parts:
        starts[r["_part"]] = before
        before += r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) if starts else F.lit(0)
    rows = ordered.withColumn("place", (offset + inside).cast("long")).drop("_part", "_row")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = checkpoint(rows.withColumn("weight", weight).withColumn("most", CAP * F.col("source_size")))
    level, full = None, -1
    while True:
        over = F.col("most") < F.lit(level) * F.col("weight") if level is not None else F.lit(False)
        r = rows.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("most"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("full")).first()
        if not r["weight"] or r["full"] == full:
            break
        level, full = (SHARE * r["all"] - r["most"]) / r["weight"], r["full"]
    return rows.withColumn("target", F.least("most", F.lit(float("inf") if level is None else level) * F.col("weight"))).drop("most")


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without return are among the ``good``."""
    if good + bad <= _MOST:
        return int(rng.hypergeometric(good, bad, n)) if good else 0
    # Beyond: probabilities relative to that of the mode, as far as doubles tell them from zero.
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    p = good / (good + bad)
    reach = int(12 * (n * p * (1 - p)) ** 0.5) + 60
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(up)])
    share = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(share, rng.random() * share[-1])])


def _split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n drawn without return."""
    out, left, total = np.zeros_like(counts), n, int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        if left <= 0:
            break
        out[i] = _hypergeometric(rng, c, total - c, left)
        left, total = left - int(out[i]), total - c
    return out


def descend(counts: np.ndarray, lo: int, hi: int, levels: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """``(first shard, end, counts)`` of the nodes ``levels`` below the node of shards ``lo`` to ``hi``, or of leaves above."""
    if hi - lo == 1 or levels == 0:
        return [(lo, hi, counts)]
    mid, total = (lo + hi) // 2, int(counts.sum())
    base, extra = divmod(total, hi - lo)
    part = _split(np.random.default_rng([seed, lo, hi]), counts, base * (mid - lo) + min(extra, mid - lo))
    return descend(part, lo, mid, levels - 1, seed) + descend(counts - part, mid, hi, levels - 1, seed)


def shard_quotas(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); columns sum to ``counts`` and rows differ by 1 at most."""
    return np.array([c for _, _, c in descend(np.array(counts, np.int64), 0, shards, 64, seed)])


def tree_quotas(counts: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(sid, pass, shard, quota)`` with a quota, from ``counts(sid, pass, quota)``: :func:`shard_quotas` as a tree of tasks.

    A task goes LEVELS down from one node, over the sources that have blocks there.
    """
    nodes = counts.select("sid", "pass", "quota", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sid", "pass"])
        out = []
        for lo, hi, c in descend(group["quota"].to_numpy(np.int64), int(group["lo"].iloc[0]), int(group["hi"].iloc[0]), LEVELS, seed):
            out.append(group.assign(quota=c, lo=lo, hi=hi)[c > 0])
        return pd.concat(out)

    for _ in range(0, max(1, (shards - 1).bit_length()), LEVELS):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(run, nodes.schema)
    return nodes.select("sid", "pass", F.col("lo").alias("shard"), "quota")


def _permuted(x: Column, n: Column, sid: Column) -> Column:
    """The place of ``x`` in a keyed permutation of 0 to n - 1: swap-or-not, which needs no sort."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED + 2), sid, r), n) - x, n)
        return F.when(F.xxhash64(F.lit(SEED + 3), sid, r, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def _base(docs: DataFrame) -> DataFrame:
    """A row per document without its text; ``occ`` numbers identical rows, which are interchangeable."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Words are what is left between runs of white space.
    size = F.size(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")
    names = ["uid"] if "uid" in docs.columns else []
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("th"), *names)
    return rows.withColumn("occ", F.row_number().over(Window.partitionBy("doc_id", "th", "source").orderBy("size")))


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(rows, blocks)``.

    rows: ``uid, doc_id, th, source, occ, size, source_size, target, passes,
    taken``, one per row of ``docs``; ``taken`` counts the words of its dealt
    blocks. blocks: ``uid, source, pass, block, start, words, shard, place``, a
    row for each document's part of a drawn block: its word range in the
    document, the block's output shard and its place there. Null texts have size
    0 and are taken 0 times; null sources form one source, the last; repeated
    rows are mixed one by one. A rerun gives the same draws. ``shards`` is by
    default what SHARD_WORDS asks for; ``seed`` is the tree's. A column ``uid``
    of ``docs``, if there, must number its rows.
    """
    base = _base(docs)
    base = checkpoint((base if "uid" in base.columns else base.withColumn("uid", F.monotonically_increasing_id())).withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))).withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    some = F.col("source_size") > 0
    plan = plan.withColumn("passes", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = checkpoint(plan.withColumn("rest", F.when(some, F.round(F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0).cast("long")).withColumnRenamed("place", "sid"))
    totals = plan.agg(F.sum("n_rows"), F.sum("source_size")).first()
    n_rows, n_words = totals[0] or 0, totals[1] or 0
    if shards is None:
        shards = max(SHARDS, -(-int(SHARE * n_words) // SHARD_WORDS))
    known = plan.select("k", "sid", "source_size", "target", "passes", "n_rows")
    rows = checkpoint(skew_join(base, known, "k", "n_rows", n_rows, saved=True).drop("k"))
    slots = _deal(plan, shards, seed)
    # The documents of a source in a random order on one line of words, cut at multiples of BLOCK_WORDS.
    line = rows.where("size > 0").select("uid", "source", "sid", "doc_id", "th", "occ", "size", F.xxhash64(F.lit(SEED), "doc_id", "th", "occ").alias("u"))
    line = prefixed(line, ["sid"], ["u", "doc_id", "th", "occ"], {"at": F.col("size")}, n_rows)
    parts = line.select("uid", "source", "sid", "size", "at", F.explode(F.expr(f"sequence(at div {BLOCK_WORDS}, (at + size - 1) div {BLOCK_WORDS})")).alias("block"))
    first, end = F.greatest(F.col("at"), F.col("block") * BLOCK_WORDS), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    parts = parts.select("uid", "source", "sid", "block", (first - F.col("at")).alias("start"), (first - F.col("block") * BLOCK_WORDS).alias("inside"), (end - first).alias("words"))
    # Spark guesses the size of both sides from before blocks were exploded and would broadcast one of any size.
    met = parts.join(slots.hint("merge"), ["sid", "block"]).withColumn("words", F.least(F.col("words"), F.col("most") - F.col("inside"))).where("words > 0")
    blocks = checkpoint(met.select("uid", "source", "pass", "block", "start", "words", "shard", "place"))
    taken = blocks.groupBy("uid").agg(F.sum("words").alias("dealt"))
    return rows.join(taken, "uid", "left").withColumn("taken", F.coalesce("dealt", F.lit(0))).drop("dealt", "sid"), blocks


def _deal(plan: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(sid, block, pass, shard, place, most)``: the blocks that shards draw, ``most`` words of each.

    ``plan(sid, source_size, passes, rest)``. A pass in full has all blocks of
    a source. Of the last pass the whole blocks needed for ``rest`` are drawn,
    one of them in part. The tree splits the quotas; a shard's stretch of a
    source's permutation is as long as its quota asks for, and it draws the
    quota's blocks from the start of its stretch.
    """
    whole, n = F.expr(f"source_size div {BLOCK_WORDS}"), F.expr(f"(source_size + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}")
    part = F.expr(f"(rest + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}")
    full = plan.where("passes > 0").select("sid", F.explode(F.expr("sequence(cast(0 as bigint), passes - 1)")).alias("pass"), n.alias("quota"), n.alias("n"), whole.alias("whole"), (n * BLOCK_WORDS).alias("words"))
    last = plan.where("rest > 0").select("sid", F.col("passes").alias("pass"), part.alias("quota"), F.when(part <= whole, whole).otherwise(n).alias("n"), whole.alias("whole"), F.col("rest").alias("words"))
    counts = checkpoint(full.union(last))
    quotas = checkpoint(tree_quotas(counts.select("sid", "pass", "quota"), shards, seed))
    earlier = Window.partitionBy("sid", "pass").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    ranges = quotas.withColumn("before", F.coalesce(F.sum("quota").over(earlier), F.lit(0))).join(counts.withColumnRenamed("quota", "all"), ["sid", "pass"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    ranges = ranges.withColumn("first", F.expr(f"{wide('before')} * {wide('n')} div {wide('all')}"))
    # Few rows make many: a quota is no larger than a shard, and tasks get about as many blocks each.
    tasks = 8 + (plan.agg(F.sum(F.col("passes") * n + part)).first()[0] or 0) // SLOT_ROWS
    drawn = ranges.repartition(tasks, "sid", "pass", "shard").select("sid", "pass", "shard", "whole", "all", "words", "before", "first", F.explode(F.expr("sequence(cast(0 as bigint), quota - 1)")).alias("i"))
    rank = F.col("first") + F.col("i")
    # What is left over after whole blocks stays at the line's end; it is drawn when all blocks are.
    block = F.when(rank < F.col("whole"), _permuted(rank, F.col("whole"), F.col("sid"))).otherwise(rank)
    most = F.when(F.col("before") + F.col("i") == F.col("all") - 1, F.col("words") - (F.col("all") - 1) * BLOCK_WORDS).otherwise(F.lit(BLOCK_WORDS))
    return drawn.select("sid", block.alias("block"), "pass", "shard", F.xxhash64(F.lit(SEED + 1), "sid", "pass", rank).alias("place"), most.alias("most"))


def dealt_documents(docs: DataFrame) -> DataFrame:
    """The mix as text: a row of ``docs`` for each part of a dealt block, with the part's words as its text, and ``_shard, _place, _start``.

    ``n_chars`` is brought up to date; other columns pass through, whatever
    their names. Rows of which the mix takes nothing go, null and empty texts
    among them. Rows are numbered in a table in the shared folder, so texts move once.
    """
    return _dealt(docs)[0]


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    names, spark = docs.columns, docs.sparkSession
    place = f"{shared_folder(spark, 'mix')}/mix-{uuid.uuid4().hex}"
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"])
    docs.select(rest.alias("row"), F.col("text").cast("string").alias("text"), "doc_id", "source", F.monotonically_increasing_id().alias("uid")).write.parquet(place)
    numbered = spark.read.parquet(place)
    _, blocks = mix(numbered.select("doc_id", "source", "text", "uid"))
    shards = (blocks.agg(F.max("shard")).first()[0] or 0) + 1
    spans = blocks.groupBy("uid").agg(F.collect_list(F.struct("shard", "place", "start", "words")).alias("spans"))  # a document's own
    joined = numbered.select("uid", "row", "text").join(spans, "uid").select("row", "text", "spans")

    def start():
        def step(rows, texts, spans):
            out: dict[str, list] = {k: [] for k in ("row", "mixed", "shard", "place", "start")}
            for r, t, s in zip(rows, texts, spans, strict=True):
                at = [m.span() for m in _WORD.finditer(t)]
                for x in s:
                    out["row"].append(r)
                    out["mixed"].append(t[at[x["start"]][0] : at[x["start"] + x["words"] - 1][1]])
                    for k in ("shard", "place", "start"):
                        out[k].append(x[k])
            yield out

        return step

    schema = f"row {joined.schema['row'].dataType.simpleString()}, mixed string, shard int, place long, start long"
    out = map_chunks(joined, start, schema)
    changed = {"text": F.col("mixed")} | ({"n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names], F.col("shard").alias("_shard"), F.col("place").alias("_place"), F.col("start").alias("_start")), shards


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The texts of :func:`dealt_documents`, a partition per shard, each in the order of its local shuffle; columns as in ``docs``.

    Rows without a doc_id and repeated rows are mixed one by one; rows without
    a word have nothing to give and go. An empty table gives an empty one.
    """
    out, shards = _dealt(docs)
    order = ["_shard", "_place", "doc_id", "_start"]
    return out.repartitionById(shards, F.col("_shard")).sortWithinPartitions(*order).select(*[f"`{c}`" for c in docs.columns])
