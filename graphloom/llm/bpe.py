"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries resynchronise.

A text beyond ``CHUNK`` characters is cut into chunks that overlap by
``OVERLAP``. Chunks are pre-tokenised in parallel. Pre-tokens depend only on
what follows their start, so from the first boundary that two neighbours share
both see the same ones: there the text is cut. The pieces between cuts are
encoded in parallel and their ids joined in order. Decoding joins the bytes of
the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Characters from one chunk's start to the next, and those by which a chunk reaches into the next.
CHUNK, OVERLAP = 32_768, 512
#: A boundary nearer to a chunk's end than this may depend on what comes after it: an apostrophe waits for two letters, white space for one character.
MARGIN = 8
#: Rows that a task holds as Python objects at a time.
CHUNK_ROWS = 100


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def ids_of(text: str, path: str, pattern: str) -> list[int]:
    """Ids of one piece. A piece far beyond a chunk is one huge pre-token or a few: each is handed over alone, as matching them natively may overflow the stack."""
    encoding = _encoding(path, pattern)
    if len(text) <= 4 * CHUNK:
        return encoding.encode_ordinary(text)
    return [i for match in regex.findall(pattern, text) for i in encoding._encode_single_piece(match)]


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of all pre-tokens, and the text's end."""
    return [m.start() for m in regex.finditer(pattern, text)] + [len(text)]


def stitch(text: str, heads: list[list[int]], tails: list[list[int]], pattern: str) -> list[int]:
    """Cuts of a text where some neighbours share no boundary: from the last sure one it is matched on until a chunk's own boundary is met.

    ``heads[k]`` and ``tails[k]`` are boundaries of chunk k in its first and
    last overlap, counted from the text's start.
    """
    cuts, sure, match = [0], True, None
    for k in range(1, len(heads)):
        head = set(heads[k])
        if sure:
            shared = head.intersection(tails[k - 1])
            if shared:
                cuts.append(min(shared))
                continue
            sure, match = False, regex.finditer(pattern, text, pos=cuts[-1])
            place = cuts[-1]
        end = max(heads[k], default=-1)
        while place <= end and place not in head:
            found = next(match, None)
            place = len(text) if found is None else found.end()
        if place in head:
            cuts.append(place)
            sure = True
    return cuts


def _arrow(df: DataFrame, function, schema) -> DataFrame:
    """``function`` over slices of CHUNK_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                yield function(batch.slice(at, CHUNK_ROWS))

    return df.mapInArrow(run, schema)


def _ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Column ``text``, the last, becomes ``ids``."""

    def encode_rows(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [ids_of(t or "", path, pattern) for t in part.column(part.num_columns - 1).to_pylist()]
        offsets = np.cumsum([0] + [len(i) for i in found]).astype(np.int32)
        values = np.concatenate([np.array(i, np.int32) for i in found]) if found else np.array([], np.int32)
        return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(values))], [*part.schema.names[:-1], "ids"])

    return _arrow(df, encode_rows, df.drop("text").withColumn("ids", F.lit(None).cast("array<int>")).schema)


def _edges(df: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(no, k, head, tail)`` of chunks ``(no, k, final, text)``. The last chunk of a text has no tail."""

    def edge_rows(part: pa.RecordBatch) -> pa.RecordBatch:
        heads, tails = [], []
        for k, final, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
            at = boundaries(text, pattern)
            last = len(text) if final else len(text) - MARGIN
            heads.append([k * chunk + x for x in at if x < overlap and x <= last])
            tails.append([] if final else [k * chunk + x for x in at if chunk <= x <= last])
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["no", "k", "head", "tail"])

    return _arrow(df, edge_rows, "no long, k long, head array<long>, tail array<long>")


def _stitched(df: DataFrame, pattern: str) -> DataFrame:
    """``(no, cuts)`` of ``(no, heads, tails, text)``."""

    def stitch_rows(part: pa.RecordBatch) -> pa.RecordBatch:
        cuts = [stitch(text, heads, tails, pattern) for heads, tails, text in zip(*[part.column(i).to_pylist() for i in (1, 2, 3)])]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(cuts, pa.list_(pa.int64()))], ["no", "cuts"])

    return _arrow(df, stitch_rows, "no long, cuts array<long>")


def _split(df: DataFrame, overlap: int, chunk: int = 0) -> DataFrame:
    """``(no, k, final, text)`` of ``(no, text)``, or of ``(no, cuts, text)`` where the cuts say where parts begin. Strings of Python are cut without walking through them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                no, text = batch.column(0)[row].as_py(), batch.column(batch.num_columns - 1)[row].as_py()
                # A chunk starts where more than an overlap is left, or it would be all overlap.
                starts = list(range(0, max(1, len(text) - overlap), chunk)) if chunk else batch.column(1)[row].as_py()
                ends = starts[1:] + [len(text)]
                for at in range(0, len(starts), CHUNK_ROWS):
                    some = range(at, min(at + CHUNK_ROWS, len(starts)))
                    texts = [text[starts[k] : ends[k] + overlap] for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([k == len(starts) - 1 for k in some]), pa.array(texts, pa.string())], ["no", "k", "final", "text"])

    return df.mapInArrow(run, "no long, k long, final boolean, text string")


def cuts(long: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(no, cuts)``: the boundaries at which each text of ``long(no, text)`` is cut, 0 first. ``no`` is unique."""
    chunks = _split(long.select("no", "text"), overlap, chunk)
    edges = _edges(chunks.repartition("no", "k"), pattern, chunk, overlap)
    by_text = edges.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("k", "head", "tail"))).alias("e"))
    by_text = checkpoint(by_text.select("no", F.col("e.head").alias("heads"), F.col("e.tail").alias("tails")))
    shared = F.transform("heads", lambda head, k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(head, F.get("tails", k - 1)))))
    plain = by_text.select("no", shared.alias("cuts"))
    met = ~F.exists("cuts", lambda c: c.isNull())
    rest = by_text.join(plain.where(~met).select("no"), "no").join(long.select("no", "text"), "no")
    return plain.where(met).union(_stitched(rest.select("no", "heads", "tails", "text"), pattern))


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` of every row and its ``ids``, by the ranks in the file ``path`` and the pattern of pre-tokens.

    Ids are those of ``tiktoken.Encoding.encode_ordinary``: strings of special
    tokens are ordinary text. A null or empty text has no ids. Rows are encoded
    one by one, so repeated rows and ids repeat in the result. Texts longer than
    ``chunk`` are numbered and checkpointed first, as their pieces are joined
    again by number; the others never move. Columns outside ``keep`` play no
    part, whatever their names are, and an empty table gives an empty one.
    """
    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = _ids(rows.where(F.length("text") <= chunk), path, pattern)
    long = checkpoint(rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("no"), "row", "text"))
    cut = long.select("no", "text").join(cuts(long, pattern, chunk, overlap), "no")
    pieces = _split(cut.select("no", "cuts", "text"), 0).select("no", "k", "text")
    joined = _ids(pieces.repartition("no", "k"), path, pattern).groupBy("no").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))
    whole = joined.select("no", F.flatten(F.col("p.ids")).alias("ids")).join(long.select("no", "row"), "no")
    return short.union(whole.select("row", "ids")).select("row.*", "ids")


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of every row and ``decoded``, the bytes of its ids joined. Null ids within an array add nothing, a null array gives null; an id that the file lacks is an error."""
    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(ids).alias("ids"))

    def decode_rows(part: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(path)
        out = [None if i is None else b"".join([table[x] for x in i if x is not None]) for i in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["row", "decoded"])

    return _arrow(rows, decode_rows, rows.drop("ids").withColumn("decoded", F.lit(None).cast("binary")).schema).select("row.*", "decoded")


@lru_cache(maxsize=4)
def _table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}
