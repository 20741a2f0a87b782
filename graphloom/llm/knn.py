"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt into shards. Each shard is split at medians into a KD-tree
with tight bounding boxes. A query visits nodes best-first by the largest
inner product that a box admits, and stops when that falls below its kth best;
the kth best found so far goes on from shard to shard. Trees are built once and
blocks of queries come to them; a block's first shard gives the kth scores that
the others start from.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SCALE = 256
QUERY_EVERY = 50
#: Rows of a shard, of a tree's leaf and of a query block.
SHARD_ROWS = 4096
LEAF_ROWS = 128
BLOCK_ROWS = 2048
#: Shards that one task visits one after another.
CHAIN = 8


class Tree:
    """A KD-tree in arrays: leaf order of rows, and for each node its rows, box, smallest id and children."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((ids,))
        self.ids, self.x = ids[order], x[order]
        spans: list[tuple[int, int]] = []
        children: list[tuple[int, int]] = []
        place = np.arange(len(ids))

        def build(lo: int, hi: int) -> int:
            node = len(spans)
            spans.append((lo, hi))
            children.append((-1, -1))
            part = self.x[place[lo:hi]]
            width = part.max(0) - part.min(0) if part.shape[1] else np.zeros(1)
            if hi - lo > leaf and width.max() > 0:
                d = int(width.argmax())
                mid = (lo + hi) // 2
                place[lo:hi] = place[lo:hi][np.argsort(part[:, d], kind="stable")]
                children[node] = (build(lo, mid), build(mid, hi))
            return node

        build(0, len(ids))
        self.ids, self.x = self.ids[place], self.x[place]
        self.spans, self.children = np.array(spans), np.array(children)
        self.low = np.array([self.x[a:b].min(0) for a, b in spans])
        self.high = np.array([self.x[a:b].max(0) for a, b in spans])
        self.first = np.array([self.ids[a:b].min() for a, b in spans])

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node: the largest inner product of the query with a point of the box."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        # Floats are exact here: products of scaled components stay far below 2 to the 53rd; else whole numbers are used.
        big = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(self.low).max(initial=0)), float(np.abs(self.high).max(initial=0)), 1.0) * max(1, q.shape[1])
        kind = np.float64 if big < 2**52 else object if big >= 2**62 else np.int64
        return plus.astype(kind) @ self.high.T.astype(kind) + minus.astype(kind) @ self.low.T.astype(kind)


class Best:
    """The k best (score, -id) of one query."""

    def __init__(self, k: int, start=()):
        self.k, self.heap = k, list(start)
        heapq.heapify(self.heap)

    def kth(self):
        return self.heap[0] if len(self.heap) == self.k else None

    def offer(self, score: int, vec: int) -> None:
        item = (score, -vec)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)


def visit(tree: Tree, queries: np.ndarray, x: np.ndarray, best: list[Best]) -> int:
    """Search one shard for all queries of a block; returns the leaves scanned."""
    if not len(tree.ids) or not len(queries):
        return 0
    bounds, scanned = tree.bounds(x), 0
    # Whole numbers without a bound where 64 bits may not hold a product; a score beyond them is an error, not a wrong number.
    kind = object if bounds.dtype == object else np.int64
    leaves = tree.children[:, 0] < 0
    tops = bounds[:, 0]
    for i in range(len(queries)):
        b, row = best[i], bounds[i]
        todo = [(-tops[i], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            kth = b.kth()
            if kth is not None and (-bound, -int(tree.first[node])) <= kth:
                if -bound < kth[0]:
                    break
                continue
            if leaves[node]:
                lo, hi = tree.spans[node]
                s = tree.x[lo:hi].astype(kind, copy=False) @ x[i].astype(kind, copy=False)
                scanned += 1
                # Only rows that can still enter: those at least as good as the kth.
                ids = tree.ids[lo:hi]
                other = ids != queries[i]
                ok = np.flatnonzero(other if kth is None else other & (s >= kth[0]))
                if len(ok) > b.k:
                    ok = ok[np.lexsort((ids[ok], -s[ok]))[: b.k]]
                for j in ok.tolist():
                    b.offer(int(s[j]), int(ids[j]))
            else:
                for child in tree.children[node]:
                    heapq.heappush(todo, (-row[child], int(child)))
    return scanned


def _pack(ids: np.ndarray, x: np.ndarray) -> dict:
    return {"ids": ids.astype("<i8").tobytes(), "x": x.astype("<i8").tobytes()}


def _unpack(ids: bytes, x: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(ids, "<i8")
    return a, np.frombuffer(x, "<i8").reshape(len(a), dims)


def _block(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    dims = int(group["dims"].iloc[0])
    x = np.array(group["x"].tolist(), np.int64).reshape(len(group), dims)
    return group["vec_id"].to_numpy(np.int64), x, dims


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, x, dims`` with whole components floor(256 * x). Null vectors and ids, and vectors with null or non-finite components, go."""
    v = F.col(column).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("x"), F.size(v).alias("dims"))


def top_k(vectors: DataFrame, k: int = 5, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query.

    Queries are rows whose vec_id is divisible by ``every``; candidates are all
    rows but those of the query's own vec_id. Ties go to the smaller vec_id. A
    vector only meets vectors of its own length. Repeated rows of a vec_id are
    candidates once each; a repeated query id gives one answer, that of its
    smallest vector. Null ids and vectors, and vectors with null or non-finite
    components, take no part; other columns are ignored and an empty table gives
    none. Scores beyond 64 bits raise an error.
    """
    rows = checkpoint(scaled(vectors))
    counts = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"))
    sized = checkpoint(counts.select(F.col("dims").alias("_d"), F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.greatest("q", F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")))
    named = rows.join(F.broadcast(sized), F.col("dims") == F.col("_d")).drop("_d")  # a row per vector length

    def shard_table(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, dims = _block(pdf)
        return pd.DataFrame([{"dims": dims, "shard": int(pdf["shard"].iloc[0]), "blocks": int(pdf["blocks"].iloc[0]), "shards": int(pdf["shards"].iloc[0]), "tree": Tree(ids, x).packed()}])

    shards = named.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).groupBy("dims", "shard").applyInPandas(shard_table, "dims int, shard int, blocks int, shards int, tree binary")
    shards = checkpoint(shards)

    def block_table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=pdf["x"].map(tuple)).sort_values(["vec_id", "t"]).drop_duplicates("vec_id")
        ids, x, dims = _block(pdf)
        return pd.DataFrame([{"dims": dims, "block": int(pdf["block"].iloc[0]), **{f"q{k}": v for k, v in _pack(ids, x).items()}}])

    blocks = named.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.col("blocks")).cast("int")).groupBy("dims", "block").applyInPandas(block_table, "dims int, block int, qids binary, qx binary")
    blocks = checkpoint(blocks)
    # Every block has a shard of its own to begin with, so that no shard is asked for by all.
    asked = shards.select("dims", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "shards", "tree").withColumn("home", F.pmod(F.col("block"), F.col("shards")) == F.col("shard")).drop("shards")
    seeds = checkpoint(_search(asked.where("home").join(blocks, ["dims", "block"]).withColumn("seed", F.lit(None).cast("binary")), k, True))
    rest = asked.where("not home").join(blocks, ["dims", "block"]).join(seeds.select("dims", "block", "seed"), ["dims", "block"])
    found = _search(rest, k, False).select(F.explode("best").alias("b")).select("b.*").union(seeds.select(F.explode("best").alias("b")).select("b.*"))
    # Chains hand in at most k rows a query each.
    best = found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "copy"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _search(pairs: DataFrame, k: int, first: bool) -> DataFrame:
    """Best of each (query block, chain of shards); a chain hands its kth score on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dims = int(pdf["dims"].iloc[0])
        qids, qx = _unpack(pdf["qids"].iloc[0], pdf["qx"].iloc[0], dims)
        seed = pdf["seed"].iloc[0]
        # The kth score found before this chain: rows below it cannot count, rows at it can.
        floor = None if seed is None else np.frombuffer(seed, "<i8").reshape(-1, 2)
        best = []
        for i in range(len(qids)):
            b = Best(k)
            if floor is not None and floor[i, 1] != np.iinfo(np.int64).min:
                b.heap = [(int(floor[i, 0]), int(floor[i, 1]))] * k
            best.append(b)
        seeded = [list(b.heap) for b in best]
        for shard in pdf.sort_values("shard").itertuples():
            visit(pickle.loads(shard.tree), qids, qx, best)
        out = []
        for q, b, s in zip(qids.tolist(), best, seeded, strict=True):
            items = b.heap if not s else [h for h in b.heap if h > s[0]]
            seen: dict[tuple[int, int], int] = {}
            for score, vec in sorted(items, reverse=True):
                seen[score, vec] = seen.get((score, vec), 0) + 1
                out.append({"query_id": q, "vec_id": -vec, "score": score, "copy": seen[score, vec]})
        low = np.iinfo(np.int64).min
        kth = np.array([b.kth() or (low, low) for b in best], "<i8").tobytes()
        return pd.DataFrame([{"dims": dims, "block": int(pdf["block"].iloc[0]), "best": out, "seed": kth}])

    schema = "dims int, block int, best array<struct<query_id:long,vec_id:long,score:long,copy:int>>, seed binary"
    chain = F.lit(0) if first else F.floor(F.col("shard") / CHAIN).cast("int")
    return pairs.withColumn("chain", chain).groupBy("dims", "block", "chain").applyInPandas(run, schema)
