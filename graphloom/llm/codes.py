"""Vector code compression: codebooks by Lloyd's rounds with Elkan's bounds.

A vector is cut into equal parts, each coded by its nearest codebook entry. A
part keeps an upper bound of the distance to its entry and a lower bound for
every entry. When entries move, bounds are shifted by their movement; an entry
is measured only where no bound proves it strictly farther, so ties are settled
by whole-number distances. Bounds are stored in a table that each round writes
anew: half a byte an entry, counted in steps above the upper bound.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, skew_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that a task measures at a time.
CHUNK_ROWS = 1024
#: Relative slack of float bounds, far above their rounding.
SLACK = 1e-6
#: Levels of a stored lower bound.
LEVELS = 15
MOST = (1 << 63) - 1


def usable(vector: str) -> Column:
    """True for a vector that is not null and holds finite components alone."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def largest(dims: int) -> int:
    """The largest magnitude of components for which all squared distances of a vector fit a long."""
    return math.isqrt(MOST // (4 * max(dims, 1))) - 1


def whole(values: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, held within ``largest``."""
    top = largest(dims)
    return np.clip(np.floor(scale * values.astype(np.float64)), -top, top).astype(np.int64)


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = whole(column.flatten().to_numpy(zero_copy_only=False), dims, scale)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all entries, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 52:  # floats hold these numbers exactly
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] - 2 * (fx @ fc.T) + (fc * fc).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def _paired(x: np.ndarray, c: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    diff = x[rows] - c[entries]
    return np.einsum("ij,ij->i", diff, diff)


class Round:
    """What all tasks of a round share: entries of each part, their distances, their movement since the round before and the steps of stored bounds."""

    def __init__(self, entries: np.ndarray, before: Round | None):
        self.entries = entries
        self.apart = np.sqrt(np.stack([_squares(c, c) for c in entries]).astype(np.float64)) * (1 - SLACK)
        away = self.apart.copy()
        for part in away:
            np.fill_diagonal(part, np.inf)
        self.nearest = away.min(2)
        self.moved = None if before is None else np.sqrt(((entries - before.entries).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        self.step_before = None if before is None else before.step
        self.step = np.maximum(self.apart.max((1, 2)) / (2 * LEVELS), SLACK)


def first_bounds(x: np.ndarray, r: Round, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and levels of lower bounds of each row, all distances measured."""
    squares = _squares(x, r.entries[p])
    entry = squares.argmin(1)  # the first of equal ones
    upper = _above(np.sqrt(np.take_along_axis(squares, entry[:, None], 1)[:, 0]))
    return entry, upper, _levels(np.sqrt(squares), upper, r.step[p])


def next_bounds(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, levels: np.ndarray, r: Round, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved, from the bounds of the round before; and how many distances were measured."""
    c = r.entries[p]
    lower = (upper * (1 - 4 * SLACK))[:, None] + levels * r.step_before[p] - SLACK - r.moved[p]
    upper = (upper + r.moved[p][entry]) * (1 + SLACK)
    out = entry.copy()
    # No entry lies strictly within twice the upper bound of the part's own, or none may be as near.
    open_ = np.flatnonzero(r.nearest[p][entry] <= 2 * upper)
    measured = len(open_)
    own = _paired(x, c, open_, entry[open_])
    upper[open_] = _above(np.sqrt(own))
    floor = np.maximum(lower, r.apart[p][entry] - upper[:, None])
    maybe = (lower[open_] <= upper[open_, None]) & (r.apart[p][entry[open_]] <= 2 * upper[open_, None])
    maybe[np.arange(len(open_)), entry[open_]] = False
    rows, entries = np.nonzero(maybe)
    if len(rows):
        measured += len(rows)
        squares = _paired(x, c, open_[rows], entries)
        floor[open_[rows], entries] = np.sqrt(squares)
        floor[open_, entry[open_]] = np.sqrt(own)
        best = np.full(maybe.shape, MOST)
        best[rows, entries] = squares
        best[np.arange(len(open_)), entry[open_]] = own
        out[open_] = best.argmin(1)
        upper[open_] = _above(np.sqrt(np.take_along_axis(best, out[open_][:, None], 1)[:, 0]))
    return out, upper, _levels(floor, upper, r.step[p]), measured


def _above(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(distance.astype(np.float32), np.float32(np.inf)).astype(np.float64)


def _levels(lower: np.ndarray, upper: np.ndarray, step: float) -> np.ndarray:
    """Whole steps between each upper bound and the lower ones. All other entries are at least as far as the nearest one, so 0 holds for them."""
    return np.clip(np.floor((lower - upper[:, None]) / step - SLACK), 0, LEVELS).astype(np.uint8)


def _packed(levels: np.ndarray) -> np.ndarray:
    if levels.shape[-1] % 2:
        levels = np.pad(levels, [(0, 0)] * (levels.ndim - 1) + [(0, 1)])
    return levels[..., ::2] << 4 | levels[..., 1::2]


def _unpacked(packed: np.ndarray, size: int) -> np.ndarray:
    return np.stack([packed >> 4, packed & 15], -1).reshape(*packed.shape[:-1], -1)[..., :size]


def _bytes(matrix: np.ndarray) -> pa.Array:
    """One binary value a row."""
    rows = np.ascontiguousarray(matrix).reshape(len(matrix), -1).view(np.uint8)
    offsets = (np.arange(len(matrix) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _values(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """The rows that ``_bytes`` wrote."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), *shape) if len(column) else np.zeros((0, *shape), kind)


def _assigned(df: DataFrame, r: Round, shape: tuple[int, int], kind: type, scale: int, last: bool) -> DataFrame:
    """One round over ``(row, vector)``, or over what the round before wrote: its state, or ``code`` and ``error`` of the last round."""
    parts, width = shape
    size = r.entries.shape[1]
    first = "vector" in df.columns
    schema = df.select("row").withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long")} if last else {c: F.lit(b"") for c in ("x", "entry", "upper", "levels")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                n = part.num_rows
                if first:
                    x = _matrix(part.column(1), parts * width, scale).reshape(n, parts, width)
                    entry, upper, levels = (np.stack(v, 1) for v in zip(*[first_bounds(x[:, p], r, p) for p in range(parts)]))
                else:
                    x = _values(part.column(1), kind, (parts, width)).astype(np.int64)
                    old = _values(part.column(2), np.uint8, (parts,)).astype(np.int64), _values(part.column(3), np.float32, (parts,)).astype(np.float64), _unpacked(_values(part.column(4), np.uint8, (parts, -(-size // 2))), size)
                    entry, upper, levels = (np.stack(v, 1) for v in zip(*[next_bounds(x[:, p], *[v[:, p] for v in old], r, p)[:3] for p in range(parts)]))
                if last:
                    error = sum(_paired(x[:, p], r.entries[p], np.arange(n), entry[:, p]) for p in range(parts))
                    yield pa.RecordBatch.from_arrays([part.column(0), _bytes(entry.astype(np.uint8)), pa.array(error, pa.int64())], ["row", "code", "error"])
                else:
                    stored = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                    yield pa.RecordBatch.from_arrays([part.column(0), _bytes(x.astype(kind)), _bytes(entry.astype(np.uint8)), _bytes(stored), _bytes(_packed(levels))], ["row", "x", "entry", "upper", "levels"])

    return df.mapInArrow(run, schema)


def _moved(state: DataFrame, entries: np.ndarray, kind: type) -> np.ndarray:
    """Each entry replaced by the mean of its parts, rounded down. A task hands on one row an entry; the driver gets as many."""
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        held = 0

        def out() -> pa.RecordBatch:
            p, e = np.nonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        for batch in batches:
            x, entry = _values(batch.column(0), kind, (parts, width)), _values(batch.column(1), np.uint8, (parts,))
            for p in range(parts):
                np.add.at(sums[p], entry[:, p], x[:, p])
                counts[p] += np.bincount(entry[:, p], minlength=size)
            held += len(x)
            if held > 1 << 30:  # sums of int32 components stay within 64 bits
                yield out()
                sums[:], counts[:], held = 0, 0, 0
        yield out()

    found = state.select("x", "entry").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    long_sum = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    totals = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(long_sum("n").alias("n"), long_sum("s").alias("s"))
    new = entries.copy()
    for row in totals.collect():  # as many rows as the codebooks have components
        new[row.part, row.entry, row.at] = int(row.s) // int(row.n)
    return new


def _delete(df: DataFrame, path: str) -> None:
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def compress(df: DataFrame, keep: list[str], key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(keep..., code, error)`` of every usable row, and the final codebooks as an array (part, entry, position).

    ``code`` holds a byte a part. Rows whose vector is null or holds null or
    non-finite components go; rows without a key stay and come last when the
    first codebooks are taken, rows of one key by their components. Repeated
    rows repeat in the result. Shorter vectors are padded with zeros to the
    longest, and that to a multiple of ``parts``. Components beyond ``largest``
    are held there, as no long can hold their distances. Fewer rows than
    ``entries`` give as many entries as rows; an empty table gives an empty one
    and codebooks without entries. Other columns play no part, whatever their
    names are. Each round's table is written to the shared folder and the one
    before it deleted: at most two of them stand there.
    """
    if entries > 256:
        raise ValueError("a code is one byte a part")
    rows = df.where(usable(vector)).select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(vector).alias("vector"), F.col(key).alias("key"))
    dims, top = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double")))))).first()
    width = -(-(dims or 0) // parts)
    sample = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.zeros((len(sample), parts * width), np.int64)
    for i, row in enumerate(sample):
        books[i, : len(row.vector)] = whole(np.array(row.vector, np.float64), parts * width, scale)
    books = books.reshape(len(sample), parts, width).transpose(1, 0, 2).copy()
    if not len(sample):
        return rows.select("row.*", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    kind = np.int16 if scale * (top or 0) < 1 << 14 else np.int32
    folder = os.path.join(shared_folder(df.sparkSession, "codes"), f"codes-{uuid.uuid4().hex}")
    state, before = rows.select("row", "vector"), None
    for k in range(rounds):
        this = Round(books, before)
        _assigned(state, this, (parts, width), kind, scale, False).write.parquet(f"{folder}/{k}")
        state = df.sparkSession.read.parquet(f"{folder}/{k}")
        if k:
            _delete(df, f"{folder}/{k - 1}")
        books, before = _moved(state, books, kind), this
    return _assigned(state, Round(books, before), (parts, width), kind, scale, True).select("row.*", "code", "error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()


def with_group_sums(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Add to each row the sum of ``value`` over the rows of its ``group``, nulls together. A group may hold most rows; sums beyond a long stop at its largest."""
    label = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = checkpoint(df.withColumn("_group", label))
    sums = rows.groupBy("_group").agg(F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias(name), F.count(F.lit(1)).alias("_n"))
    return skew_join(rows, sums, "_group", "_n", rows.count(), saved=True).drop("_group")
