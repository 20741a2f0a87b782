"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits. It is cut into two segments of 32 bits; two
fingerprints that differ in at most 3 bits agree in one segment up to one bit.
Every distinct fingerprint is stored under both segments, and asks for all
values within one bit of its own segments. Matches are verified on all bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, map_chunks, skew_join

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Buckets of more distinct fingerprints than this are verified in blocks.
BUCKET_JOIN = 64
BLOCK = 4096
_SPAN = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of lower-cased (A-Z) words in 3-word shingles.

    Fewer words than a shingle has: the whole sequence. No word: zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SPAN):
        part = words[at : at + _SPAN + SHINGLE - 1]
        grams = zip(*[part[i:] for i in range(SHINGLE)], strict=False) if len(words) >= SHINGLE else [words]
        h = np.array([digest(join(g), SEED) for g in grams], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """``(doc_id, fp)`` and the long columns ``others``; ``fp`` is the fingerprint as a signed long."""

    def start():
        def step(ids, texts, *rest):
            out = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield {"doc_id": ids, "fp": out.tolist(), **dict(zip(others, rest, strict=True))}

        return step

    return map_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), *others), start, "doc_id long, fp long" + "".join(f", {c} long" for c in others))


def _segment_keys(fp):
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))
    return low, high


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Verified links between the probes and the stored fingerprints of one block pair, as a spanning forest."""
    a = group.loc[group["probe"], "fp"].to_numpy(np.int64)
    b = group.loc[~group["probe"], "fp"].to_numpy(np.int64)
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    pairs: list[tuple[int, int]] = []
    for at in range(0, len(a), 512):
        near = np.bitwise_count((a[at : at + 512, None] ^ b[None, :]).view(np.uint64)) <= DISTANCE
        for i, row in enumerate(near):
            hit = ib[row]
            roots, first = np.unique(label[hit], return_index=True)
            own = label[ia[at + i]]
            for r, j in zip(roots, first, strict=True):
                if r != own:
                    pairs.append((nodes[ia[at + i]], nodes[hit[j]]))
                    label[label == r] = own
    return pd.DataFrame(pairs, columns=["a", "b"], dtype=np.int64)


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose closure joins every two of ``fp`` within 3 bits.

    Buckets of few fingerprints are joined; larger ones are dealt into pairs
    of blocks, each of which yields a spanning forest of its links, so what is
    made stays linear in a bucket's size.
    """
    fps = distinct_fps.select("fp")
    low, high = _segment_keys(F.col("fp"))
    index = checkpoint(fps.select("fp", F.explode(F.array(low, high)).alias("key")))
    bits = F.sequence(F.lit(0), F.lit(31))
    ball = lambda k: F.transform(bits, lambda b: k.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    probe = fps.select("fp", F.explode(F.array_distinct(F.concat(F.array(low), ball(low), F.array(high), ball(high)))).alias("key"))
    sizes = checkpoint(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_JOIN))
    hot = sizes.count() > 0
    near = F.expr(f"bit_count(a ^ b) <= {DISTANCE}")
    cold_index = index.join(sizes, "key", "left_anti") if hot else index
    found = probe.withColumnRenamed("fp", "a").join(cold_index.withColumnRenamed("fp", "b"), "key").where(near & F.col("a").__ne__(F.col("b"))).select("a", "b")
    if hot:
        asked = checkpoint(skew_join(probe, sizes.select("key", (F.col("n") * 66).alias("n")), "key", "n", 66 * distinct_fps.count()))
        blocks = sizes.join(asked.groupBy("key").agg(F.count(F.lit(1)).alias("p")), "key").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("p") / BLOCK).cast("int").alias("pb"))
        deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(blocks, "key").select("key", deal("pb").alias("i"), every("nb").alias("j"), "fp", F.lit(True).alias("probe"))
        right = index.join(blocks, "key").select("key", every("pb").alias("i"), deal("nb").alias("j"), "fp", F.lit(False).alias("probe"))
        found = found.union(left.union(right).groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest doc_id reachable over links of 3 or fewer
    differing bits. Null or empty texts have fingerprint zero and link like
    any other. Rows without a doc_id get a component_id if a linked row has
    one. Repeated rows give repeated result rows, an empty table none; texts of
    any length are read whole. Extra columns are ignored.
    """
    rows = checkpoint(fingerprints(docs))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    component = connected_components(links(classes))
    member = classes.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component"))
    member = checkpoint(member)
    heads = member.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    named = skew_join(member, heads, "component", "fps", member.count(), saved=True).select("fp", "component_id", "n")
    return skew_join(rows, named, "fp", "n", rows.count(), saved=True).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest ``(doc_id, text hash)``, rows without an id last.

    Rows count one by one: a row without a doc_id, or with one that other texts
    share, stays if its group has no smaller row. Of rows equal in id and text
    one stays. Null and empty texts are one group, as fingerprint zero. Other
    columns pass through, whatever their names; an empty table gives an empty one.
    """
    text_hash = F.xxhash64("text")
    rows = checkpoint(fingerprints(docs.select("doc_id", "text", text_hash.alias("h")), "h"))
    classes = checkpoint(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")))
    component = connected_components(links(classes))
    member = classes.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("component", "fp").alias("component"))
    keep = checkpoint(member.groupBy("component").agg(F.min("first").alias("first")).select("first.no_id", F.coalesce("first.doc_id", F.lit(0)).alias("d"), "first.h"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), text_hash.alias("h"))
    # Texts that no group chose go before any row moves by its key; equal rows are few once only chosen ones are left.
    return given.join(keep, ["no_id", "d", "h"], "left_semi").dropDuplicates(["no_id", "d", "h"]).select("row.*")
