"""Periodic runs of words: block matching by an integer-sequence automaton.

A run with smallest period q holds, near its start, an aligned block of b words,
b being the largest power of two up to q, and the same block again q words on.
For each b the aligned blocks of a document become keys of an automaton over
integer sequences, which is led across the whole document once; a block that
occurs again at a distance in [b, 2b) is extended both ways, word by word, to
the longest stretch of that period.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and this many times its period.
MIN_WORDS, MIN_TIMES = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that an extension compares first; each further step takes twice as many.
FIRST_STEP = 32
#: Rows that a task holds as Python objects at a time.
CHUNK_ROWS = 200
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbers_of(words: list[str]) -> np.ndarray:
    """Each word as a number, the same for equal words."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def _extent(a: np.ndarray, at: int, end: int, d: int) -> tuple[int, int]:
    """The longest stretch [start, end) of period ``d`` around [at, end), which has that period."""
    start, step = at, FIRST_STEP
    while start:
        low = max(0, start - step)
        off = np.flatnonzero(a[low:start] != a[low + d : start + d])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start, step = low, 2 * step
    step = FIRST_STEP
    while end < len(a):
        high = min(len(a), end + step)
        off = np.flatnonzero(a[end:high] != a[end - d : high - d])
        if len(off):
            end += int(off[0])
            break
        end, step = high, 2 * step
    return start, end


def _primitive(a: np.ndarray, start: int, d: int) -> bool:
    """Whether ``d`` is the smallest period of a stretch of period ``d`` that is at least twice as long: no d/r with a prime r is one."""
    rest, r = d, 2
    while rest > 1:
        if rest % r:
            r = r + 1 if r * r <= rest else rest
            continue
        p = d // r
        if np.array_equal(a[start : start + d], a[start + p : start + p + d]):
            return False
        while rest % r == 0:
            rest //= r
    return True


def find_runs(a: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """All runs of ``a`` as (start, length, smallest period), by start, then period; ``min_times`` is 4 at least.

    A block that lies in a run of period b/4 or less occurs often. An
    occurrence in that same run adds nothing; in another run, only the distance
    between the ends of both can be a period. Any other block occurs about four
    times at most in the window, so each size of block asks for a number of
    extensions in proportion to the document.
    """
    if min_times < 4:
        raise ValueError("runs of fewer than four periods need not hold an aligned block and its copy")
    n = len(a)
    if n < max(min_words, min_times):
        return []
    # Distance from each word to its next occurrence: a block takes part only if each of its words comes again within 2b.
    order = np.argsort(a, kind="stable")
    again = np.full(n, n, np.int64)
    same = a[order[1:]] == a[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: list[tuple[int, int, int]] = []
    sequence = None
    b = 1
    while min_times * b <= n:
        blocks = n // b
        starts = np.flatnonzero(again[: blocks * b].reshape(blocks, b).max(1) < 2 * b) * b
        if len(starts):
            sequence = sequence or tuple(a.tolist())
            keys, block_of = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
            for s in starts.tolist():
                key = sequence[s : s + b]
                if key not in block_of:
                    block_of[key] = len(block_of)
                    keys.add_word(key, block_of[key])
            keys.make_automaton()
            places: list[list[int]] = [[] for _ in block_of]
            for last, block in keys.iter(sequence):
                places[block].append(last - b + 1)
            owner = np.full(n, -1, np.int64)
            for i, (start, length, period) in enumerate(runs):
                if 4 * period <= b <= length:
                    owner[start : start + length - b + 1] = i
            seen: dict[int, int] = {}  # by distance, the end of the last stretch extended
            for s in starts.tolist():
                where = places[block_of[sequence[s : s + b]]]
                for t in where[bisect_left(where, s + b) : bisect_left(where, s + 2 * b)]:
                    d, mine, other = t - s, owner[s], owner[t]
                    if mine >= 0 and other >= 0 and (mine == other or sum(runs[mine][:2]) + d != sum(runs[other][:2])):
                        continue
                    if t + b <= seen.get(d, -1):
                        continue
                    start, end = _extent(a, s, t + b, d)
                    seen[d] = end
                    if end - start >= max(min_words, min_times * d) and _primitive(a, start, d):
                        runs.append((start, end - start, d))
        b *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: Iterable[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def collapse_runs(docs: DataFrame, keep: list[str], text: str = "text", min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """The columns ``keep`` of every row with ``n_words``, its ``runs`` and the ``collapsed`` text; no shuffle.

    Rows are judged one by one: repeated rows and ids repeat in the result. A
    null, empty or blank text has no word, no run and an empty collapsed text.
    Texts of any length are taken whole; a task holds a few of them at a time
    and, of one document, the automaton of one block size. Columns outside
    ``keep`` play no part, whatever their names are; an empty table gives an
    empty one. Words are code-point sequences between white space of ASCII.
    """
    out = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"))
    schema = out.drop("text").withColumns({"n_words": F.lit(0).cast("long"), "runs": F.lit(None).cast(RUNS), "collapsed": F.lit("")}).schema
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                counts, found, texts = [], [], []
                for value in part.column(1).to_pylist():
                    words = WORD.findall(value or "")
                    runs = find_runs(numbers_of(words), min_words, min_times)
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(" ".join(collapse(words, runs) if runs else words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(item)), pa.array(texts, pa.string())], ["row", "n_words", "runs", "collapsed"])

    return out.mapInArrow(run, schema).select("row.*", "n_words", "runs", "collapsed")
