"""Packing tokenised documents into sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces. The histogram of piece lengths, at most 2048
rows, is packed longest length first; the length at hand goes to the pack with
the most room. Packs are pattern counts, so the work does not grow with the
number of documents. Pieces find their place again by their rank among the
pieces of their length.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_chunks, prefixed

MAX_LEN = 2048
END = 1
#: Entries of a task's word cache; it is emptied when full.
CACHE = 600_000
#: What the tokenizer's own \s drops: as str.split, but for U+001C to U+001F, which it keeps.
_KEPT = re.compile(r"[\x1c-\x1f]")
#: Beyond Latin-1, or where a special token may begin, or a separator that Python alone takes for white space: such texts are cut as they stand.
_RAW = re.compile(r"[^\x00-\x1b\x20-;=-\xff]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters of ASCII and Latin-1, whose lower case is the same for Python and the tokenizer, then marks that neither join letters nor begin a special token.
_PLAIN = re.compile(r"([a-zA-Zà-öø-ÿÀ-ÖØ-Þ]+)([.,!?;:%*&$#\"()\-]*)\Z")


class Tokens:
    """Ids of whole texts by a public tokenizer file, one white-space-free chunk at a time.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its chunks in order. Chunks are cached as bytes of
    little-endian unsigned 32-bit ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case letters alone, the same model without the normaliser and the pattern.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache: dict[str, bytes] = {}

    def _encode(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, chunks: set[str]) -> None:
        """Fill the cache. Letters alone are one unit with one word end, so many are encoded as one text and cut at word ends."""
        words, marks, plain, odd = set(), set(), [], []
        for c in chunks:
            m = _PLAIN.match(c)
            if m is None:
                odd.append(c)
                continue
            word, mark = m.groups()
            low = word.lower()
            if mark or low != word:
                plain.append((c, low, mark))
            if mark:
                marks.add(mark)
            words.add(low)
        names = [w for w in words if w not in self.cache]
        odd += [m for m in marks if m not in self.cache]
        for at in range(0, len(names), 500):
            part = names[at : at + 500]
            ids = self._encode(" ".join(part), self.letters)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, lo = ids.tobytes(), 0
                for w, hi in zip(part, (cuts * 4).tolist(), strict=True):
                    self.cache[w] = raw[lo:hi]
                    lo = hi
            else:
                for w in part:
                    self.cache[w] = self._encode(w).tobytes()
        for c in odd:
            self.cache[c] = self._encode(c).tobytes()
        for c, w, mark in plain:
            self.cache[c] = self.cache[w] + (self.cache[mark] if mark else b"")

    def texts(self, texts: list[str | None]) -> list[bytes]:
        # The tokenizer lowers the case: Python writes a final sigma, and special tokens are matched before. Where neither can be, it is lowered here, for fewer chunks.
        chunked = [[] if not t else t.lower().split() if not _RAW.search(t) else [c for c in _SPACE.split(t) if c] if _KEPT.search(t) else t.split() for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        new = {c for x in chunked for c in x if c not in self.cache}
        if new:
            self._learn(new)
        return [b"".join(map(self.cache.__getitem__, x)) for x in chunked]


def pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``, and ``ids`` if asked for: every document cut at multiples of ``max_len``.

    A document's ids end with id 1; a null or empty text has that one alone.
    """

    def start():
        tokens, end = Tokens(tokenizer), np.array([END], "<u4").tobytes()

        def step(doc_ids, texts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids)}
            for d, raw in zip(doc_ids, tokens.texts(texts), strict=True):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, max_len):
                    part = raw[at * 4 : (at + max_len) * 4]
                    for k, v in (("doc_id", d), ("start", at), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part)), ("doc_tokens", n)):
                        out[k].append(v)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int64))
            yield out

        return step

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    return map_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, schema)


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of each packing pattern. Every length is placed in the open packs with the most room."""
    open_packs: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if room == 0:
            done.append((count, pattern))
            return
        if room not in open_packs:
            heapq.heappush(rooms, -room)
            open_packs[room] = []
        open_packs[room].append([count, pattern])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            while rooms and not open_packs.get(-rooms[0]):
                open_packs.pop(-heapq.heappop(rooms), None)
            if not rooms or -rooms[0] < length:
                fit = max_len // length
                whole, rest = divmod(left, fit)
                if whole:
                    put(max_len - fit * length, whole, (length,) * fit)
                if rest:
                    put(max_len - rest * length, 1, (length,) * rest)
                break
            room = -rooms[0]
            count, pattern = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append([count - used, pattern])
            put(room - length, used, (*pattern, length))
            left -= used
    return done + [(c, p) for packs in open_packs.values() for c, p in packs]


def pack(cut: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; all their columns pass through.

    Sequences are numbered from 0, those of packed pieces first. Offsets in a
    sequence are gapless from 0. Needs columns ``doc_id``, ``start``,
    ``length``.
    """
    spark = cut.sparkSession
    names = cut.columns
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = pack_histogram(counts, max_len)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    first = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((used[length], first, offset))
            used[length] += count
            offset += length
        first += count
    # One row per length, with the rank at which each pattern slot begins: its size depends on max_len alone.
    rows = [(length, [x[0] for x in s], [x[1] for x in s], [x[2] for x in s]) for length, s in slots.items()]
    table = spark.createDataFrame(rows, "_l long, lo array<long>, seq array<long>, off array<int>")
    keyed = cut.withColumn("_u", F.xxhash64("doc_id", "start", "length"))
    ranks = prefixed(keyed, ["length"], ["_u", "doc_id", "start"], {"_rank": F.lit(1).cast("long")}, sum(counts.values()))
    slot = F.size(F.filter("lo", lambda x: x <= F.col("_rank")))
    placed = ranks.join(F.broadcast(table), F.col("length") == F.col("_l")).withColumn("_slot", slot)
    return placed.select(*names, F.expr("seq[_slot - 1] + _rank - lo[_slot - 1]").alias("sequence_id"), F.expr("cast(off[_slot - 1] as bigint)").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece, see :func:`pieces` and :func:`pack`.

    Repeated rows are packed once each; ties among equal pieces do not matter.
    A null or empty text is one piece of the end id alone, texts of any length
    are read whole, null ids pass, other columns are ignored and an empty table
    gives none.
    """
    return pack(checkpoint(pieces(docs, tokenizer, max_len, keep_ids)), max_len)
