"""Substring dedup by sliding sentence spans.

A run is the shortest sequence of consecutive sentences, two at least, of
RUN_WORDS words or more. Every run that begins at a sentence, and every run
that ends at one, is hashed; a sentence of SOLO_WORDS words is a run by itself,
as long as several. Hashes meet in one global join, and sentences covered by a
non-first occurrence of a run are removed. Any two equal stretches of whole
sentences with that many words are covered by their common runs from end to end.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_chunks, skew_join

RUN_WORDS = 20
SOLO_WORDS = 25


class Runs(NamedTuple):
    """What a run is: the fewest words and sentences of one, and the words from which a sentence is a run by itself (None: never)."""

    words: int = RUN_WORDS
    sentences: int = 2
    solo: int | None = SOLO_WORDS


DEFAULT = Runs()
#: Every three consecutive sentences, however short, and no sentence by itself.
EXACT = Runs(0, 3, None)
#: Letters that count as a word at least, for scripts that write no spaces.
WORD_LETTERS = 6
_BREAK = re.compile(r"\n|(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f\uff0e])\s*")


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, normal form, words)`` of each sentence with a word; one ends where white space follows a mark, at a full-width mark, or at a line's end."""
    out, at = [], 0
    for end in [*[m.end() for m in _BREAK.finditer(text)], len(text)]:
        words = text[at:end].lower().split()
        if words:
            form = " ".join(words)
            out.append((at, end, form, max(len(words), (len(form) - len(words) + 1) // WORD_LETTERS)))
        at = end
    return out


def run_spans(sizes: list[int], rule: Runs = DEFAULT) -> list[tuple[int, int]]:
    """``(first, end)`` sentences of every run, by size in words: forwards from each first one, backwards from each last one, and long sentences alone."""
    n, out = len(sizes), set()
    j = total = 0
    for a in range(n):
        while j < n and (total < rule.words or j - a < rule.sentences):
            total += sizes[j]
            j += 1
        if total >= rule.words and j - a >= rule.sentences:
            out.add((a, j))
        if rule.solo is not None and sizes[a] >= rule.solo:
            out.add((a, a + 1))
        total -= sizes[a]
    i, total = n, 0
    for b in range(n, 0, -1):
        while i > 0 and (total < rule.words or b - i < rule.sentences):
            i -= 1
            total += sizes[i]
        if total >= rule.words and b - i >= rule.sentences:
            out.add((i, b))
        total -= sizes[b - 1]
    return sorted(out)


def run_hashes(parts: list[tuple[int, int, str, int]], rule: Runs = DEFAULT) -> list[tuple[int, int, int]]:
    """``(hash, first sentence, sentences)`` of every run, in text order."""
    digest, out = xxhash.xxh64_intdigest, []
    forms = [p[2] for p in parts]
    for a, b in run_spans([p[3] for p in parts], rule):
        h = digest("\n".join(forms[a:b]))
        out.append((h - (1 << 64) if h >= 1 << 63 else h, a, b - a))
    return out


def _clean(text: str | None, flagged: set[int], copy: bool, rule: Runs = DEFAULT) -> tuple[str | None, list[dict]]:
    """The text without covered sentences, and the spans removed. Of a ``copy`` of an earlier row every run is a repeat."""
    if not text:
        return text, []
    parts = sentences(text)
    seen: dict[int, int] = {}
    gone = bytearray(len(parts))
    for h, i, k in run_hashes(parts, rule):
        # Non-first: another row has it earlier, or it stands earlier here (clear of its own copy).
        if copy or h in flagged or seen.setdefault(h, i) + k <= i:
            gone[i : i + k] = b"\1" * k
    spans: list[list[int]] = []
    for (start, end, *_), x in zip(parts, gone, strict=True):
        if x and spans and not text[spans[-1][1] : start].strip():
            spans[-1][1] = end
        elif x:
            spans.append([start, end])
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    out = "".join([*kept, text[at:]])
    return (out.strip() if spans else text), [{"start": a, "end": b} for a, b in spans]


def _cleaned(docs: DataFrame, rule: Runs) -> DataFrame:
    """``row, clean_text, removed`` of every row of ``docs``; see :func:`dedup`."""
    text = F.col("text").cast("string")
    # A row's place in the order of rows: id (none: last), then the hash of its text.
    place = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("th")]

    def start_runs():
        def step(no_id, doc, th, texts):
            out: dict[str, list] = {k: [] for k in ("h", "no_id", "doc", "th")}
            for n, d, x, t in zip(no_id, doc, th, texts, strict=True):
                own = {r[0] for r in run_hashes(sentences(t), rule)} if t else ()
                out["h"] += own
                for k, v in (("no_id", n), ("doc", d), ("th", x)):
                    out[k] += [v] * len(own)
            yield out

        return step

    runs = checkpoint(map_chunks(docs.select(*place, text.alias("text")), start_runs, "h long, no_id boolean, doc long, th long"))
    at = F.struct("no_id", "doc", "th")
    met = runs.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = met.where("first < last").select("h", "first", "n")
    later = skew_join(runs, repeated, "h", "n", runs.count(), saved=True).where(at > F.col("first"))
    flagged = later.groupBy("no_id", "doc", "th").agg(F.collect_set("h").alias("flagged"))  # no more than the text's own runs
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *place)
    copy = F.row_number().over(Window.partitionBy("no_id", "doc", "th").orderBy(F.lit(1))) > 1
    joined = keyed.join(flagged, ["no_id", "doc", "th"], "left").select("row", F.col("row.text").cast("string").alias("text"), "flagged", copy.alias("copy"))

    def start_clean():
        def step(rows, texts, flags, copies):
            out = [_clean(t, set(f or ()), c, rule) for t, f, c in zip(texts, flags, copies, strict=True)]
            yield {"row": rows, "clean_text": [x[0] for x in out], "removed": [x[1] for x in out]}

        return step

    schema = f"row {keyed.schema['row'].dataType.simpleString()}, clean_text string, removed array<struct<start:int,end:int>>"
    return map_chunks(joined, start_clean, schema)


def dedup(docs: DataFrame, rule: Runs = DEFAULT) -> DataFrame:
    """Every row of ``docs`` with ``clean_text`` and ``removed``, its removed character spans.

    ``rule`` says what a run is: with EXACT every three consecutive sentences.
    The first occurrence of a run is that of the smallest ``(doc_id, hash of the
    text)``, rows without a doc_id last, and within a row the earliest; it
    stays. Rows count one by one, whatever ids they share: of rows equal in id
    and text one is the first and loses nothing to the others. Null or empty
    texts, and texts shorter than a run, stay as they are; texts of any length
    are read whole. All other columns pass through; one named like a result
    column gives way to it. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c.lower() not in ("clean_text", "removed")]
    return _cleaned(docs, rule).select(*[F.col(f"row.`{c}`") for c in names], "clean_text", "removed")


def remove_repeats(docs: DataFrame, rule: Runs = DEFAULT) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars`` brought up to date.

    Rows left without a word go, and so do rows whose text is null or empty.
    Rows without a doc_id, and rows that share one, are treated one by one as
    in :func:`dedup`. Columns stay as they are, whatever their names.
    """
    out = _cleaned(docs, rule).where(F.coalesce(F.col("clean_text"), F.lit("")).rlike(r"\S"))
    changed = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def repeated_runs(docs: DataFrame, rule: Runs = DEFAULT, text: str = "text") -> DataFrame:
    """``(h, n)``: hashes of runs that stand ``n`` times, twice at least, in all texts together."""

    def start():
        def step(texts):
            yield {"h": [h for t in texts if t for h, _, _ in run_hashes(sentences(t), rule)]}

        return step

    runs = map_chunks(docs.select(F.col(text).cast("string")), start, "h long")
    return runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
