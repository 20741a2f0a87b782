"""Language identification by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A whole text
is parsed greedily against each automaton into longest matches, as of Ziv and
Merhav; phrases are normalised by what one costs, the logarithm of the length
of the language's training text, and the language with fewest wins.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks

#: Labelled documents of a language that are learned from, whole; longer ones than TRAIN_LONGEST characters only where a language has no others.
TRAIN_DOCS = 16
TRAIN_LONGEST = 20_000
#: Characters of a row of the parse. Rows of all texts advance together; a text's parse is then carried over its rows.
WIDTH = 1024
FOLDS = 5


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text: letters stay, all else becomes single spaces."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _squeeze(codes)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    table = _LETTER
    out = table[np.minimum(codes, len(table) - 1)]
    high = codes >= len(table)
    if high.any():
        out[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return out


_LETTER = np.array([chr(c).isalpha() for c in range(0x3100)] + [False])


def _squeeze(codes: np.ndarray) -> np.ndarray:
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    out = np.where(letter, codes, 32)[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


class Automata:
    """Suffix automata of all languages as one sparse table of transitions; state 0 is none, and each language has its own root.

    Rows of transitions are laid over one another (row displacement): a state's
    move by symbol c stands at ``base[state] + c``, and ``owner`` there says
    whose it is. The size grows with the training text alone, not with the
    alphabet.
    """

    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        coded = [letters(training[x]) for x in self.langs]
        #: What a phrase costs in each language, in bits.
        self.cost = np.array([math.log2(len(c) + 2) for c in coded])
        self.alphabet = np.unique(np.concatenate([*coded, np.array([32], np.uint32)]))
        moves: list[dict[int, int]] = [{}]
        roots = []
        for codes in coded:
            start = len(moves)
            roots.append(start)
            moves += [{c: to + start for c, to in m.items()} for m in self._build(np.searchsorted(self.alphabet, codes).tolist())]
        self.roots = np.array(roots, np.int64)
        self._lay(moves)

    def _lay(self, moves: list[dict[int, int]]) -> None:
        size = sum(map(len, moves))
        taken = bytearray(size * 2 + 2 * len(self.alphabet) + 64)
        base = np.zeros(len(moves), np.int64)
        # Wide rows first, each from where the last one fitted; single moves fill the gaps in the end.
        at = 0
        for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
            cs = sorted(moves[s])
            if not cs:
                break
            if len(cs) == 1:
                at = 0
                break
            tries = 0
            while at < cs[0] or any(taken[at - cs[0] + c] for c in cs):
                tries += 1
                at = taken.find(0, at + (1 if tries < 32 else 64))
                if at < 0 or at + cs[-1] - cs[0] >= len(taken):
                    at = len(taken)
                    taken += bytes(len(taken))
            base[s] = at - cs[0]
            for c in cs:
                taken[at - cs[0] + c] = 1
        for s, m in enumerate(moves):
            for c in m if len(m) == 1 else ():
                at = taken.find(0, max(at, c))
                if at < 0:
                    at = len(taken)
                    taken += bytes(len(taken))
                base[s], taken[at] = at - c, 1
        n = int(base.max(initial=0)) + len(self.alphabet) + 1
        self.base, self.owner, self.to = base, np.zeros(n, np.int32), np.zeros(n, np.int32)
        for s, m in enumerate(moves):
            for c, to in m.items():
                self.owner[base[s] + c], self.to[base[s] + c] = s, to

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that ``symbol`` leads to; 0 where there is none."""
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.to[at], 0)

    @staticmethod
    def _build(symbols: list[int]) -> list[dict[int, int]]:
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        return nexts

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns): the parse of the whole text from left to right."""
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum() or not self.langs:
            return counts
        none = len(self.alphabet)
        flat = np.concatenate(texts)
        at = np.minimum(np.searchsorted(self.alphabet, flat), none - 1)
        symbols = np.where(self.alphabet[at] == flat, at, none).astype(np.int64)
        del flat, at
        ends = np.cumsum(sizes)
        n_rows = -(-sizes // WIDTH)
        text_of = np.repeat(np.arange(len(texts)), n_rows)
        first = np.repeat(ends - sizes, n_rows) + (np.arange(n_rows.sum()) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows)) * WIDTH
        last = np.minimum(first + WIDTH, ends[text_of])
        goes_on = last < ends[text_of]
        for k, root in enumerate(self.roots):
            # Every row is parsed as if a phrase began with it.
            breaks = np.zeros(len(symbols), bool)
            order = np.argsort(first - last, kind="stable")
            sorted_state, at = np.full(len(first), root), first[order]
            alive = np.searchsorted((first - last)[order], -np.arange(WIDTH), side="left")
            for j in range(int((last - first).max())):
                n = alive[j]
                sorted_state[:n] = self._advance(sorted_state[:n], at[:n] + j, symbols, root, breaks)
            state = np.empty_like(sorted_state)
            state[order] = sorted_state
            # From a row's end its parse is carried on until it breaks where the row there breaks too: from then on they are one.
            extra, meets = np.zeros(len(first), np.int64), ends[text_of].copy()
            starts = np.zeros(len(symbols) + 1, bool)
            starts[first] = True
            rows, pos, now = np.flatnonzero(goes_on), last[goes_on], state[goes_on]
            while len(rows):
                mine = np.zeros(len(rows), bool)
                now = self._advance(now, pos, symbols, root, None, mine)
                extra[rows] += mine
                met = mine & (breaks[pos] | starts[pos])
                meets[rows[met]] = pos[met] + 1
                stay = ~met & (pos + 1 < ends[text_of[rows]])
                rows, pos, now = rows[stay], pos[stay] + 1, now[stay]
            total = np.concatenate([[0], np.cumsum(breaks)])
            text_rows = np.cumsum(n_rows) - n_rows
            # The phrase that the text's end closes, and the breaks on the way from row to row.
            found = (sizes > 0).astype(np.int64)
            for t in np.flatnonzero(n_rows > 1).tolist():
                at, end = int(ends[t] - sizes[t]), int(ends[t])
                while at < end:
                    r = int(text_rows[t] + (at - 1 - (end - sizes[t])) // WIDTH) if at > end - sizes[t] else int(text_rows[t])
                    found[t] += total[last[r]] - total[at] + extra[r]
                    at = int(meets[r])
            one = n_rows == 1
            found[one] += total[ends[one]] - total[(ends - sizes)[one]]
            counts[:, k] = found
        return counts

    def _advance(self, state, pos, symbols, root, breaks, mine=None):
        """One symbol on. A state without a move breaks: the symbol begins the next phrase."""
        c = symbols[pos]
        to = self._step(state, c)
        stop = np.flatnonzero(to == 0)
        if len(stop):
            again = self._step(np.full(len(stop), root), c[stop])
            to[stop] = np.where(again == 0, root, again)
            if breaks is not None:
                breaks[pos[stop]] = True
            if mine is not None:
                mine[stop] = True
        return to


def training_text(docs: DataFrame) -> dict[str, str]:
    """Whole texts of at most TRAIN_DOCS documents of each language from the training folds.

    The documents are those with the smallest hash in each of TRAIN_DOCS
    slices of a language, found without moving texts. Equal texts count once.
    """
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    row = F.struct((F.length("text") > TRAIN_LONGEST).alias("long"), F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    slice_ = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(TRAIN_DOCS)).alias("slot")
    slots = seen.groupBy("lang", slice_).agg(F.min(row).alias("m")).select("lang", "m.long", "m.h")
    short = slots.groupBy("lang").agg(F.min("long").alias("_long")).withColumnRenamed("lang", "_lang")
    slots = slots.join(short, (F.col("lang") == F.col("_lang")) & (F.col("long") == F.col("_long"))).select("lang", "h")
    # At most TRAIN_DOCS rows for each language.
    picked = seen.select("lang", row["h"].alias("h"), "text").join(F.broadcast(slots), ["lang", "h"]).dropDuplicates(["lang", "text"])
    texts: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in picked.toLocalIterator():
        texts[r["lang"]].append((r["h"], r["text"]))
    return {k: " ".join(t for _, t in sorted(v)) for k, v in texts.items()}


def identify(docs: DataFrame, automata: Automata) -> DataFrame:
    """``doc_id, lang_pred, score, n_letters, phrases`` of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything when no language was learned. Ties go to the smaller name. The
    score weighs the bits of the best against those of the second best; with one
    language it is 1. Texts of any length are parsed whole. Other columns are
    ignored, null ids pass; repeated rows give repeated results and an empty
    table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def start():
        model = shared.value
        names = np.array([*model.langs, "und"], object)

        def step(ids, texts):
            coded = [letters(t) for t in texts]
            sizes = np.array([len(x) for x in coded])
            counts = model.phrases(coded)
            known = (sizes > 0) & bool(model.langs)
            bits = counts * model.cost
            best = bits.argmin(1) if model.langs else np.zeros(len(ids), int)
            pred = names[np.where(known, best, len(model.langs))]
            score = np.zeros(len(ids))
            if len(model.langs) > 1:
                two = np.partition(bits, 1, axis=1)[:, :2]
                # Bits saved by the best, as a log-odds that grows with the text.
                score = 1 / (1 + np.exp(-np.clip((two[:, 1] - two[:, 0]) * 0.05, 0, 30)))
            elif model.langs:
                score = np.ones(len(ids))
            least = counts[np.arange(len(ids)), best] if model.langs else np.zeros(len(ids), int)
            yield {"doc_id": ids, "lang_pred": pred.tolist(), "score": np.where(known, score, 0.0).tolist(), "n_letters": sizes.tolist(), "phrases": np.where(known, least, 0).tolist()}

        return step

    return map_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, "doc_id long, lang_pred string, score double, n_letters long, phrases long", rows=500)


def held_out(doc_id: int) -> bool:
    """The rule by which the query sets documents aside, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
