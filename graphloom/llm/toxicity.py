"""Toxicity by a weighted finite-state pattern grammar.

A tagger turns words into classes. Three transducers read classes from left to
right: negation and reported speech mark the insults and threats that follow
within their scope, and a clause machine joins what is left with targets into
one event a clause. They are composed once into a single table of transitions,
whose arcs that close a clause bear the weight of its event. A document's arcs
are pooled by event; weights come from a bounded sample of labelled documents,
within bounds that the grammar sets: negated and reported insults and a single
insult without a target stay below the threshold at any length of text, targeted
insults and threats lie above it.

Insults are a fixed list and stems learned from the sample: openings of words
that occur in toxic documents and hardly in others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_chunks

FOLDS, HELD_OUT = 4, 2
#: Labelled documents that a fit may read at most, those of smallest hash.
SAMPLE_DOCS = 6000
#: Shortest and longest opening of a word that may become a stem.
STEM = (3, 9)
#: A whole word or stem stands in at least so many toxic documents; a stem opens so many different words there.
LEAST_DOCS, LEAST_KINDS = 4, 3
#: Of the documents that have it, this share is toxic: whole words, stems.
PRECISION_WORD, PRECISION_STEM = 0.9, 0.8
#: Nats by which its toxic share must exceed chance. At 7, one word in 1,000 gets there by luck; one word alone decides nothing.
LEAST_EVIDENCE = 7.0
#: Signatures of a document; sampled documents that share any of them count once.
SIGNATURES = 3

# Seed lists, in English, German, French and Spanish.
INSULTS = frozenset("idiot idiots moron morons loser losers scum trash clown clowns worthless pathetic disgusting stupid imbecile fool dumb dumm dumme trottel abschaum widerlich crétin connard débile ordures idiota idiotas imbécil estúpido estúpida basura".split())
THREATS = frozenset("kill hurt destroy punish burn crush beat stab shoot strangle töten töte umbringen verprügeln erschießen tuer tuerai frapper brûler matar mataré golpear quemar".split())
TARGETS = frozenset("you your you're yourself they them he she him her is are was were this that these those tu te toi vous votre ils du dich dir ihr euch sie er ellos usted ustedes ti eres sind ist bist est es son".split())
VICTIMS = frozenset("you your yourself them him her te toi vous votre dich dir euch ihn usted ustedes ti".split())
NEGATIONS = frozenset("not never no nobody none neither nor without isn't aren't wasn't weren't don't doesn't didn't won't wouldn't cannot can't hardly nicht kein keine keiner niemand ohne nie niemals ne n'est n'es pas aucun personne sans ni jamais nunca nadie sin ninguno ninguna".split())
REPORTS = frozenset("said says say called calls quoted quotes claimed claims wrote writes accused accuses alleged alleges according reported reportedly sagte schrieb behauptete nannte zufolge laut disait écrivait selon accusé dijo escribió según acusó acusado".split())

#: Words that a negation, a report and a target reach to the right, a threat to its victim, and an insult to whom it is flung at ("idiot like you").
NEGATION_REACH, REPORT_REACH, TARGET_REACH, THREAT_REACH, INSULT_REACH = 4, 10, 4, 3, 2
EVENTS = ("isolated", "loose", "targeted", "negated", "reported", "threat")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_BREAK = frozenset(".!?;\n")
THRESHOLD = 0.3
#: What a document's pooled arcs are: whether it has an insult without a target, how many more of these, the other events, and the share of its words that such further and targeted insults are.
FEATURES = ("single", "repeated", "targeted", "negated", "reported", "threat", "share")
#: What each weighs before any label is seen, then the intercept.
PRIOR = np.array([0.2, 3.0, 3.0, 0.2, 0.2, 3.5, 0.5])
PRIOR_INTERCEPT = -2.0
#: The most that a negated or reported insult may weigh, and the log-odds of one threat at least.
WEAK, SURE = 0.25, 0.5

# Classes of words: other, insult, threat, target, victim, negation, report, break. Marked ones: negated and reported insult or threat.
CLASSES = "oihtvnrb"
Transducer = Callable[[tuple, str], tuple[tuple, str]]


def _mark(reach: int, trigger: str, marks: dict[str, str]) -> Transducer:
    """After ``trigger``, classes in ``marks`` become their marked form for ``reach`` words, up to a break. The state counts what is left."""

    def step(state: tuple, x: str) -> tuple[tuple, str]:
        (left,) = state
        if x == "b":
            return (0,), x
        if x == trigger:
            return (reach,), "o"
        return (max(0, left - 1),), marks.get(x, x) if left else x

    return step


NEGATION = _mark(NEGATION_REACH, "n", {"i": "I", "h": "o"})
REPORT = _mark(REPORT_REACH, "r", {"i": "Q", "h": "o", "I": "Q"})
_RANK = ["", "negated", "reported", "isolated", "loose", "targeted", "threat"]


def _clause(state: tuple, x: str) -> tuple[tuple, str]:
    """The clause machine: the strongest event so far, whether another word stood there and what is left of an insult's reach, and the same of a target and of a threat.

    A further insult in a clause is an event of its own, at its word.
    """
    best, others, target, threat = state
    if x == "b":
        name = _RANK[best]
        return (0, 0, 0, 0), ("loose" if name == "isolated" and others & 1 else name) or "o"
    rise = lambda name: max(best, _RANK.index(name))
    out, reach = "o", others >> 1
    if x == "i":
        if best >= _RANK.index("isolated"):
            out = "loose"
        best = rise("targeted" if target else "isolated")
    elif x in "IQ":
        best = rise("negated" if x == "I" else "reported")
    elif x == "v":
        best = rise("threat" if threat else "targeted" if reach else "")
    others = (others & 1 or int(x != "i")) | (INSULT_REACH if x == "i" else max(0, reach - 1)) << 1
    return (best, others, TARGET_REACH if x in "tv" else max(0, target - 1), THREAT_REACH if x == "h" else max(0, threat - 1)), out


def compose(machines: list[tuple[Transducer, tuple]]) -> tuple[list[list[int]], list[list[str]]]:
    """One machine that feeds each machine's output to the next: next state and output by state and class, from state 0. Only states that can be reached are made."""
    start = tuple(s for _, s in machines)
    number, todo, nexts, outs = {start: 0}, [start], [], []
    for state in todo:
        row, out = [], []
        for x in CLASSES:
            new = []
            for (machine, _), s in zip(machines, state, strict=True):
                s, x = machine(s, x)
                new.append(s)
            if tuple(new) not in number:
                number[tuple(new)] = len(todo)
                todo.append(tuple(new))
            row.append(number[tuple(new)])
            out.append(x)
        nexts.append(row)
        outs.append(out)
    return nexts, outs


_NEXT, _OUT = compose([(NEGATION, (0,)), (REPORT, (0,)), (_clause, (0, 0, 0, 0))])
_EVENT = [[EVENTS.index(x) if x in EVENTS else -1 for x in row] for row in _OUT]


@dataclass(frozen=True)
class Grammar:
    stems: frozenset[str]
    words: frozenset[str]
    weights: tuple[float, ...] = tuple(PRIOR)
    intercept: float = PRIOR_INTERCEPT

    def tagger(self):
        """word -> the number of its class, remembered per task."""
        memory: dict[str, int] = {}
        lengths = sorted({len(s) for s in self.stems})

        def tag(word: str) -> int:
            out = memory.get(word)
            if out is None:
                name = "o"
                if word in self.words or word in INSULTS or any(word[:n] in self.stems for n in lengths):
                    name = "i"
                else:
                    for known, c in ((THREATS, "h"), (NEGATIONS, "n"), (REPORTS, "r"), (VICTIMS, "v"), (TARGETS, "t"), (_BREAK, "b")):
                        if word in known:
                            name = c
                            break
                out = CLASSES.index(name)
                if len(memory) < 500_000:
                    memory[word] = out
            return out

        return tag

    def events(self, text: str | None, tag) -> tuple[list[int], int]:
        """Clauses by event, and the number of words and breaks."""
        counts = [0] * len(EVENTS)
        if not text:
            return counts, 0
        tags = [*map(tag, _WORD.findall(text.lower())), _END]
        if _INSULT in tags or _THREAT in tags:
            state = 0
            for x in tags:
                event = _EVENT[state][x]
                if event >= 0:
                    counts[event] += 1
                state = _NEXT[state][x]
        return counts, len(tags) - 1

    def features(self, text: str | None, tag) -> list[float]:
        return _features(*self.events(text, tag))

    def score(self, text: str | None, tag) -> float:
        return self._score(self.features(text, tag))

    def _score(self, x: list[float]) -> float:
        z = self.intercept + float(np.dot(self.weights, x))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_INSULT, _THREAT, _END = (CLASSES.index(x) for x in "ihb")


def _features(counts: list[int], n: int) -> list[float]:
    """The pooled arcs, as FEATURES names them."""
    plain = counts[0] + counts[1]
    more = max(0, plain - 1)
    return [float(plain > 0), math.log1p(more), *np.log1p(counts[2:]).tolist(), 100 * (more + counts[2]) / (n + 20)]


def _openings(text: str) -> dict[str, set[int]]:
    """Word openings of a text, and whole words closed by a mark, with hashes of the words that have them."""
    out: dict[str, set[int]] = {}
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        h = xxhash.xxh32_intdigest(w)
        for n in range(STEM[0], min(STEM[1], len(w)) + 1):
            out.setdefault(w[:n], set()).add(h)
        out[w + "$"] = {h}
    return out


def _signatures(text: str) -> list[int]:
    """Smallest hashes of the 3-word shingles under several seeds: near copies mostly share each of them."""
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return [min(xxhash.xxh32_intdigest(x, seed=k) for x in shingles) for k in range(SIGNATURES)]


def _evidence(toxic: int, clean: int, base: float) -> float:
    """Nats of surprise that so many of the documents with a word are toxic, at a toxic share of ``base``; 0 where they are not more than that."""
    n = toxic + clean
    p = toxic / n
    if p <= base:
        return 0.0
    return n * (p * math.log(p / base) + (0.0 if clean == 0 else (1 - p) * math.log((1 - p) / (1 - base))))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, toxic, h)`` of at most SAMPLE_DOCS documents of the training folds, near copies once."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT
    named = labels.where(fold & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    # A top-N by hash: each task keeps SAMPLE_DOCS rows at most, of two numbers each.
    few = F.broadcast(named.orderBy("h").limit(SAMPLE_DOCS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(few, "doc_id").select("text", "toxic", "h")

    def start():
        def step(texts, toxic, h):
            yield {"text": texts, "toxic": toxic, "h": h, "sig": [_signatures(t) for t in texts]}

        return step

    signed = checkpoint(map_chunks(rows, start, "text string, toxic int, h long, sig array<long>"))
    first = signed.select("toxic", "h", "sig")
    for k in range(SIGNATURES):
        first = first.groupBy("toxic", F.col("sig")[k].alias("_s")).agg(F.min(F.struct("h", "sig")).alias("one")).select("toxic", "one.h", "one.sig")
    return checkpoint(signed.join(F.broadcast(first.select("toxic", "h")), ["toxic", "h"]).groupBy("toxic", "h").agg(F.min("text").alias("text")).select("text", "toxic", "h"))


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Stems and weights from labels and texts of the training folds. Without labels, the fixed lists and priors."""
    sample = training_sample(docs, labels)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    stems: set[str] = set()
    if n_toxic and n_clean:

        def openings(only: frozenset[str] | None):
            def start():
                def step(texts):
                    count: Counter = Counter()
                    words: dict[str, set[int]] = {}
                    for t in texts:
                        for k, v in _openings(t).items():
                            if only is None or k in only:
                                count[k] += 1
                                words.setdefault(k, set()).update(v)
                    names = list(count)
                    yield {"name": names, "n": [count[k] for k in names], "words": [sorted(words[k])[:8] for k in names]}

                return step

            return start

        schema = "name string, n long, words array<long>"
        many = lambda df, only: map_chunks(df.select("text"), openings(only), schema)
        found = many(sample.where("toxic = 1"), None)
        toxic = {r["name"]: r["n"] for r in found.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).toLocalIterator()}
        names = frozenset(toxic)
        clean = {r["name"]: r["n"] for r in many(sample.where("toxic = 0"), names).groupBy("name").agg(F.sum("n").alias("n")).toLocalIterator()}
        kinds = {r["name"]: r["n"] for r in many(sample.where("toxic = 1"), names).select("name", F.explode("words").alias("w")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
        for name in sorted(toxic, key=lambda x: (len(x), x)):
            n, other = toxic[name], clean.get(name, 0)
            whole = name[-1] == "$"
            sure = n / (n + other + 0.2) >= (PRECISION_WORD if whole else PRECISION_STEM) and _evidence(n, other, n_toxic / (n_toxic + n_clean)) >= LEAST_EVIDENCE
            if sure and (whole or kinds.get(name, 0) >= LEAST_KINDS) and not any(name.startswith(s) for s in stems):
                stems.add(name)
    grammar = Grammar(frozenset(s for s in stems if s[-1] != "$"), frozenset(s[:-1] for s in stems if s[-1] == "$"))
    if not (n_toxic and n_clean):
        return grammar

    def start():
        tag = grammar.tagger()

        def step(texts, toxic):
            yield {"x": [[float(v) for v in grammar.features(t, tag)] for t in texts], "y": toxic}

        return step

    rows = map_chunks(sample.select("text", "toxic"), start, "x array<double>, y int").collect()  # SAMPLE_DOCS rows of eight numbers at most
    w = _fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))
    return Grammar(grammar.stems, grammar.words, tuple(w[:-1].tolist()), float(w[-1]))


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic weights, drawn towards the priors, by Newton steps; then brought within the grammar's bounds."""
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.array([*PRIOR, PRIOR_INTERCEPT])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return _bounded(w)


def _bounded(w: np.ndarray) -> np.ndarray:
    """Negated and reported insults weigh between 0 and WEAK; one insult without a target stays below THRESHOLD; one targeted insult reaches it; one threat gives more than even odds."""
    w = w.copy()
    name = {e: i for i, e in enumerate(FEATURES)}
    bar = math.log(THRESHOLD / (1 - THRESHOLD))
    w[-1] = min(w[-1], bar - SURE)
    for e, most in (("single", 0.75 * (bar - w[-1])), ("negated", WEAK), ("reported", WEAK)):
        w[name[e]] = min(max(w[name[e]], 0.0), most)
    w[name["repeated"]] = max(w[name["repeated"]], 0.0)
    w[name["share"]] = max(w[name["share"]], 0.0)
    w[name["targeted"]] = max(w[name["targeted"]], w[name["repeated"]], (bar + WEAK - w[-1]) / math.log(2))
    w[name["threat"]] = max(w[name["threat"]], (SURE - w[-1]) / math.log(2))
    return w


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score, n_clauses`` of every row; null or empty texts score like a text without matches.

    Texts of any length are read whole, null ids pass and other columns are
    ignored; repeated rows give repeated results and an empty table none.
    """

    def start():
        tag = grammar.tagger()

        def step(ids, texts):
            events = [grammar.events(t, tag) for t in texts]
            nothing = grammar.score(None, tag)
            yield {"doc_id": ids, "score": [grammar._score(_features(*e)) if any(e[0]) else nothing for e in events], "n_clauses": [sum(e[0]) for e in events]}

        return step

    return map_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, "doc_id long, score double, n_clauses int")
