"""The training-data operators against plain versions, and on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphloom.llm import html, knn, language, license, mixing, packing, quality, simhash, substring, toxicity
from graphloom.llm.common import connected_components
from graphloom.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, clean_text string, _h int, fp string"
PASSAGE = " ".join(f"Sentence number {i} of the shared passage has several plain words." for i in range(8))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that clash with the operators' own."""
    long = " ".join(f"word{i % 997} stands{i % 31}." for i in range(30_000))
    texts = [None, "", "   \n ", "one", "one two", long, f"Alpha begins here. {PASSAGE} Omega ends.", f"Other words open. {PASSAGE} Different close.", "you are an idiot now. you are an idiot now.", "All rights reserved. CC BY-NC 4.0", "x\x00y   z \U0001f600"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "h", "r", "c", 1, "f") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "one two three four", "en", "s0", 3, None, None, None, None, None), (3, "another text of id three", "en", None, 1, "h", "r", "c", 1, "f")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    """Smallest id reachable of each place in a list of (id, fp)."""
    n = len(fps)
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return [min((fps[j][0] for j in range(n) if label[j] == label[i] and fps[j][0] is not None), default=None) for i in range(n)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    expected = Counter((i, f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == expected


def test_simhash_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_JOIN", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(1)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 3)), replace=False)) for b in rng.integers(0, 2**63, 4) for _ in range(40)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    found = connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    got = {r.node: r.component for r in found.collect()}
    label = plain_components(list(zip(signed, fps, strict=True)))
    assert [got.get(f, f) for f in signed] == label


def test_keep_one(odd, empty):
    kept = simhash.keep_one(odd).collect()
    # Rows count one by one: unlike texts that share id 3 both stay.
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) and [r.doc_id for r in kept].count(3) == 2 and set(simhash.keep_one(odd).columns) == set(odd.columns)
    assert {6, 5, 0} <= {r.doc_id for r in kept} and not {1, 2} & {r.doc_id for r in kept}
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_of_each_group(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    hashed = spark.createDataFrame([(t,) for t in (a, b)], "text string").selectExpr("text", "xxhash64(text) h").orderBy("h").collect()
    low, high = hashed[0].text, hashed[1].text
    rows = [(5, low), (5, high), (3, low), (None, c), (None, c), (None, d), (7, d), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(3, low), (5, high), (None, c), (7, d), (None, None)])


def test_substring(odd, empty):
    out = substring.dedup(odd).collect()
    assert len(out) == odd.count()
    # Of three equal rows of id 6 one is the first.
    same, second = sorted((r for r in out if r.doc_id == 6), key=lambda r: len(r.removed)), next(r for r in out if r.doc_id == 7)
    assert len(same) == 3 and not same[0].removed and same[0].clean_text == same[0].text and all(PASSAGE[:-1] not in r.clean_text for r in same[1:])
    assert PASSAGE[:-1] not in second.clean_text and second.clean_text.startswith("Other words open.") and second.clean_text.endswith("Different close.")
    assert sum(s.end - s.start for s in second.removed) >= 0.9 * len(PASSAGE)
    assert substring.dedup(empty).count() == 0
    left = substring.remove_repeats(odd)
    assert left.columns == odd.columns and all(r.text.strip() for r in left.collect())


def test_substring_against_plain(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: x[0])
    first, expected = {}, {}
    for i, t in rows:
        parts = substring.sentences(t)
        for h, at, k in substring.run_hashes(parts):
            first.setdefault(h, (i, at))
        gone = set()
        for h, at, k in substring.run_hashes(parts):
            d, p = first[h]
            if d != i or p + k <= at:
                gone.update(range(at, at + k))
        expected[i] = sum(len(parts[x][2]) for x in gone)
    got = {r.doc_id: sum(len(p[2]) for p in substring.sentences(r.text)) - sum(len(p[2]) for p in substring.sentences(r.clean_text)) for r in substring.dedup(docs).collect()}
    # Sentences may run together where something between them went, so lengths agree up to spaces.
    assert all(abs(got[i] - expected[i]) <= 0.02 * expected[i] + 3 for i in expected)


def test_substring_runs(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n)) + ". "
    japanese = "".join(f"\u4eca\u65e5\u306f{chr(0x4e00 + i)}\u306e\u5929\u6c17\u304c\u3068\u3066\u3082\u826f\u3044\u3067\u3059\u3002" for i in range(30))
    passages = [words("a", 15) + words("b", 15), words("c", 10) + words("d", 10) + words("e", 10), words("f", 28), japanese, words("g", 30) + "".join(f"short {i}. " for i in range(3))]
    rows = [(k, f"Opening of text {k} here. {p} Closing words {k}.") for k in (1, 2) for p in passages]
    short = "The. Of it. And so."
    rows += [(3, f"One begins. {short} It ends."), (4, f"Another one. {short} Ends too."), (None, words("n", 40)), (None, words("n", 40)), (None, "q. " + words("n", 40)), (7, words("m", 40)), (7, words("m", 40))]
    out = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = Counter((r.doc_id, bool(r.removed)) for r in out)
    assert removed == Counter({(1, False): 5, (2, True): 5, (3, False): 1, (4, False): 1, (None, False): 1, (None, True): 2, (7, False): 1, (7, True): 1})
    # What whole sentences share goes from end to end.
    assert all(re.sub(r"\W", "", r.clean_text).startswith("Openingoftext2here") and r.clean_text.endswith("Closing words 2.") and len(r.clean_text) < 60 for r in out if r.doc_id == 2)


def test_run_spans_cover_common_stretches():
    rng = np.random.default_rng(11)
    for _ in range(200):
        sizes = rng.integers(1, 14, int(rng.integers(2, 12))).tolist()
        left, right = rng.integers(1, 14, 3).tolist(), rng.integers(1, 14, 3).tolist()
        inside = [(a - 3, b - 3) for a, b in substring.run_spans(left + sizes + right) if a >= 3 and b <= 3 + len(sizes)]
        covered = {i for a, b in inside for i in range(a, b)}
        assert sum(sizes) < substring.RUN_WORDS or covered == set(range(len(sizes)))


def test_quality(odd, empty):
    out = quality.apply_policy(quality.ledger(odd)).collect()
    assert len(out) == odd.count()
    got = {(r.doc_id, r.n_words): r for r in out}
    assert got[0, 0].base_failed and got[4, 2].n_words == 2 and got[8, 10].n_repeat_words == 10
    for r in odd.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert got[r.doc_id, len(w)].n_repeat_words == len(covered)
    assert quality.ledger(empty).count() == 0
    table = {(r.version, r.rule): r for r in quality.ablations(quality.ledger(odd)).collect()}
    assert table["base", "few_words"].rejected >= table["base", "few_words"].rejected_by_this_rule_alone > 0
    assert quality.keep_good(odd).columns == odd.columns


def test_mixing(odd, empty, docs):
    for df in (odd, docs):
        rows, blocks = mixing.mix(df)
        got = rows.toPandas()
        assert len(got) == df.count()
        real = got.groupby("source", dropna=False).agg(t=("taken", "sum"), target=("target", "first"), s=("size", "sum"))
        assert (abs(real.t - real.target) <= 1).all() and (got.taken <= 2 * got["size"]).all()
        assert abs(real.target.sum() - 1.5 * real.s.sum()) < 1e-6 * real.s.sum()
        assert Counter(map(tuple, mixing.mix(df)[0].select("doc_id", "size", "taken").collect())) == Counter(map(tuple, rows.select("doc_id", "size", "taken").collect()))
        per = blocks.groupBy("uid").sum("words").toPandas()
        assert per["sum(words)"].sum() == got.taken.sum()
        n = blocks.select("shard", "source", "pass", "block").distinct().groupBy("shard").count().toPandas()["count"]
        assert n.max() - n.min() <= 1 or len(n) < mixing.SHARDS
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(words(r.text) for r in mixed.collect()) == got.taken.sum()
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed_documents(odd).columns == odd.columns


def test_mixing_meets_blocks_by_a_shuffle(docs, monkeypatch):
    """Few quotas make any number of blocks, which Spark's guess of their size does not see: they are not broadcast."""
    plans, was = [], mixing.checkpoint

    def checkpoint(df):
        out = was(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(mixing, "checkpoint", checkpoint)
    mixing.mix(docs)
    assert {x for p in plans for x in re.findall(r"(\w+) \[sid#\d+L?, block#", p) if x.endswith("Join")} == {"SortMergeJoin"}


def test_mixing_deals(spark, docs, monkeypatch):
    _, blocks = mixing.mix(docs)
    dealt = mixing.dealt_documents(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size = lambda rows: Counter((r.shard, r.place, r.start, r.words) for r in rows)
    assert Counter((r._shard, r._place, r._start, words(r.text)) for r in dealt) == size(blocks.collect())
    whole = {(r.doc_id, w): None for r in docs.collect() for w in [" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))]}
    by_id = {i: w for i, w in whole}
    assert all(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)) in by_id[r.doc_id] and r.n_chars == len(r.text) for r in dealt)
    order = [(r.doc_id, r.text) for r in sorted(dealt, key=lambda r: (r._shard, r._place, r.doc_id, r._start))]
    assert [(r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect()] == order and len({r._shard for r in dealt}) == mixing.SHARDS
    # What the query counts is what the splitting tree dealt: with a shard's range lost, its words are gone.
    before = queries()["op7_mixing"](spark, SF).agg({"taken": "sum"}).first()[0]
    deal = mixing._deal
    monkeypatch.setattr(mixing, "_deal", lambda *given: deal(*given).where("shard > 0"))
    lost = sum(r.words for r in blocks.collect() if r.shard == 0)
    assert lost > 0 and queries()["op7_mixing"](spark, SF).agg({"taken": "sum"}).first()[0] == before - lost


def spark_hash(*values):
    """xxhash64 of longs, strings and (as numpy int32) ints, null ones skipped."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.tobytes() if isinstance(v, np.int32) else np.int64(v).tobytes(), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_taken(rows, shards, seed):
    """Words taken of each of ``(doc_id, text, source)``, by lists and loops."""
    i32, b = np.int32, mixing.BLOCK_WORDS
    seen, docs = Counter(), []
    for i, t, s in rows:
        th = spark_hash(t)
        seen[i, th, s] += 1
        docs.append((i, t, s, th, seen[i, th, s], len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, s))
    goal = plain_targets({f"{k:06}": sum(d[5] for d in docs if d[2] == s) for k, s in enumerate(names)})
    counts, spread = [], []
    for sid, s in enumerate(names):
        n = sum(d[5] for d in docs if d[2] == s)
        passes = int(goal[f"{sid:06}"] // n) if n else 0
        rest = round(goal[f"{sid:06}"] - passes * n) if n else 0
        spread += [(sid, p, -(-n // b), -(-n // b) * b) for p in range(passes)]
        if rest:
            q = -(-rest // b)
            spread.append((sid, passes, n // b if q <= n // b else -(-n // b), rest))
            counts.append(q)
            counts[-1:] = [-(-n // b)] * passes + [q]
        else:
            counts += [-(-n // b)] * passes
    quotas = mixing.shard_quotas(counts, shards, seed)
    most = Counter()
    for col, (sid, p, n, words) in enumerate(spread):
        total, whole, before = counts[col], sum(d[5] for d in docs if d[2] == names[sid]) // b, 0
        for q in quotas[:, col].tolist():
            for i in range(q):
                x = before * n // total + i
                if x < whole:
                    for r in range(1, mixing.ROUNDS + 1):
                        other = (spark_hash(i32(mixing.SEED + 2), sid, i32(r)) - x) % whole
                        x = other if spark_hash(i32(mixing.SEED + 3), sid, i32(r), max(x, other)) % 2 else x
                most[sid, p, x] = words - (total - 1) * b if before + i == total - 1 else b
            before += q
    taken = [0] * len(docs)
    for sid, s in enumerate(names):
        at = 0
        mine = [(spark_hash(i32(mixing.SEED), d[0], d[3], i32(d[4])), (d[0] is not None, d[0]), d[3], d[4], k) for k, d in enumerate(docs) if d[2] == s and d[5]]
        for *_, k in sorted(mine):
            for (sid2, _, x), m in most.items():
                if sid2 == sid:
                    taken[k] += max(0, min(at + docs[k][5], x * b + m) - max(at, x * b))
            at += docs[k][5]
    return Counter((d[0], d[5], t) for d, t in zip(docs, taken, strict=True))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing_against_plain(which, request):
    df = request.getfixturevalue(which)
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    got = {}
    for seed in (mixing.SEED, 5):
        got[seed] = Counter(map(tuple, mixing.mix(df, 16, seed)[0].select("doc_id", "size", "taken").collect()))
        assert got[seed] == plain_taken(rows, 16, seed)
    assert which == "odd" or got[mixing.SEED] != got[5]


def test_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 3000).withColumn("n", F.when(F.col("id") < 1000, 1000).when(F.col("id") < 1007, 7).otherwise(1993).cast("long"))
    df = df.withColumn("x", F.when(F.col("id") < 1000, F.col("id")).when(F.col("id") < 1007, F.col("id") - 1000).otherwise(F.col("id") - 1007))
    got = df.select("n", "x", mixing._permuted(F.col("x"), F.col("n"), F.lit(3).cast("long")).alias("y")).collect()
    for n in (1000, 7, 1993):
        assert sorted(r.y for r in got if r.n == n) == list(range(n)) and (n < 10 or sum(r.x == r.y for r in got if r.n == n) < 12)


def test_large_draws():
    rng = np.random.default_rng(4)
    good, bad, n = 3 * 10**9, 7 * 10**9, 10**9
    drawn = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(60)], float)
    sd = (n * 0.3 * 0.7 * (good + bad - n) / (good + bad)) ** 0.5
    assert abs(drawn.mean() - 3 * 10**8) < 5 * sd / 60**0.5 and 0.6 < drawn.std() / sd < 1.4
    q = mixing.shard_quotas([5 * 10**9, 3, 0, 2 * 10**9], 5)
    assert q.sum(0).tolist() == [5 * 10**9, 3, 0, 2 * 10**9] and q.sum(1).max() - q.sum(1).min() <= 1


def test_tree_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVELS", 2)
    counts = [70, 0, 5, 33, 1]
    df = spark.createDataFrame([(i // 2, i % 2, c) for i, c in enumerate(counts) if c], "sid long, pass long, quota long")
    got = {(r["shard"], 2 * r["sid"] + r["pass"]): r["quota"] for r in mixing.tree_quotas(df, 21).collect()}
    want = mixing.shard_quotas([c for c in counts if c], 21)
    columns = [i for i, c in enumerate(counts) if c]
    assert got == {(s, i): int(want[s, k]) for s in range(21) for k, i in enumerate(columns) if want[s, k]}


def plain_targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left, free = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i:02}": int(x) for i, x in enumerate(rng.integers(1, 10_000, n))}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_shard_quotas():
    q = mixing.shard_quotas([100, 7, 0, 33], 8)
    assert q.sum(0).tolist() == [100, 7, 0, 33] and q.sum(1).max() - q.sum(1).min() <= 1


def test_packing(odd, empty, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for df in (odd, docs):
        out = packing.pack_documents(df, tokenizer_path(), keep_ids=True).toPandas()
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
        texts = {(r.doc_id, r.text) for r in df.collect()}
        ids = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in texts)
        if df is docs:
            whole = out.sort_values("start").groupby("doc_id").ids.apply(lambda x: tuple(int(v) for a in x for v in a))
            assert Counter(whole) == ids
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out.itertuples())
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_tokens_of_raw_text():
    tokens = packing.Tokens(tokenizer_path())
    texts = ["a\x1cb c", "\u039f\u0394\u039f\u03a3 x", "J\u030c j\u030c", "<|EndOfText|> <|endoftext|>", "\u00c0\u00c9B Stra\u00dfe. WORD, Word word", "a\x85b\xa0c\u3000d\u200be"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.texts(texts)] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_any_unicode():
    rng = np.random.default_rng(8)
    tokens = packing.Tokens(tokenizer_path())
    pools = [range(0x20, 0x7F), range(0, 0x250), range(0x370, 0x530), range(0x2000, 0x2070), range(0x3000, 0x3100), range(0x0300, 0x0370), range(0x1F600, 0x1F640), [9, 10, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x3A3, 0x130, 0xDF], range(0, 0xD800), range(0xE000, 0x110000)]
    texts = []
    for _ in range(10_000):
        pool = [pools[int(i)] for i in rng.integers(0, len(pools), 3)]
        texts.append("".join(chr(p[int(rng.integers(0, len(p)))]) for p in (pool[int(i)] for i in rng.integers(0, 3, int(rng.integers(0, 30))))))
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [t for t, raw, ids in zip(texts, tokens.texts(texts), want, strict=True) if np.frombuffer(raw, "<u4").tolist() != ids]
    assert not bad, [ascii(t) for t in bad[:5]]


def test_pack_histogram():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 2049, 5000).tolist())
    packed = packing.pack_histogram(counts)
    used = Counter()
    for c, p in packed:
        assert sum(p) <= 2048
        for x in p:
            used[x] += c
    assert used == counts
    assert sum(c for c, _ in packed) * 2048 < 1.05 * sum(k * v for k, v in counts.items())


def test_language(odd, empty, docs):
    model = language.Automata(language.training_text(docs))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if language.held_out(r.doc_id)]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    out = {(r.doc_id, r.n_letters): r for r in language.identify(odd, model).collect()}
    assert out[0, 0].lang_pred == out[1, 0].lang_pred == "und" and all(0 <= r.score <= 1 for r in out.values())
    assert language.training_text(empty) == {} and {r.lang_pred for r in language.identify(odd, language.Automata({})).collect()} == {"und"}


def plain_phrases(text, train):
    """A phrase is the longest match; the letter that breaks it begins the next."""
    n, start = int(bool(text)), 0
    for at, c in enumerate(text):
        if text[start : at + 1] not in train:
            n, start = n + 1, at if c in train else at + 1
    return n


@pytest.mark.parametrize("width", [7, 16, 1024])
def test_phrases_against_plain(width, monkeypatch):
    monkeypatch.setattr(language, "WIDTH", width)
    rng = np.random.default_rng(2)
    train = {k: "".join(rng.choice(list("abcd e"), 300)) for k in "xyz"}
    model = language.Automata(train)
    plain = {k: "".join(map(chr, language.letters(v))) for k, v in train.items()}
    texts = ["".join(rng.choice(list("abcde fz"), int(rng.integers(0, 150)))) for _ in range(60)] + [plain["x"], plain["y"] * 3, "z", "", "zz" * 40]
    coded = [language.letters(t) for t in texts]
    strings = ["".join(map(chr, c)) for c in coded]
    assert model.phrases(coded).tolist() == [[plain_phrases(s, plain[k]) for k in model.langs] for s in strings]
    # A copy of the training text is one phrase, however long.
    assert model.phrases([language.letters(plain["x"])])[0, 0] == 1


def test_language_against_plain(docs, odd):
    texts = language.training_text(docs)
    model = language.Automata(texts)
    plain = {k: "".join(map(chr, language.letters(v))) for k, v in texts.items()}
    rows = [r for r in docs.union(docs.limit(5)).collect() if r.text and len(r.text) < 1500][:60] + [r for r in odd.collect() if len(r.text or "") < 1500]
    for r, got in zip(rows, language.identify(docs.sparkSession.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").coalesce(1), model).collect(), strict=True):
        s = "".join(map(chr, language.letters(r.text)))
        bits = {k: plain_phrases(s, v) * np.log2(len(v) + 2) for k, v in plain.items()}
        assert got.lang_pred == (min(sorted(bits), key=bits.get) if s else "und")


def test_language_of_many_signs():
    """The table grows with the text, not with the alphabet."""
    signs = "".join(chr(0x4E00 + i % 3000) for i in range(9000))
    model = language.Automata({"a": signs, "b": "plain words"})
    assert len(model.owner) < 8 * 9000 and model.phrases([language.letters(signs[100:5000])]).argmin() == 0


def test_substring_exact_setting(spark):
    """Three short sentences that two texts share are one run of EXACT, a single long sentence is none; against all windows of three."""
    short, long = "It is a fine day today. We went to the old shop. Nobody came back home again.", " ".join(f"w{i}" for i in range(26)) + "."
    rows = [(1, f"Alpha opens here. {short} One end."), (2, f"Beta opens now. {short} Other end."), (3, f"Gamma. {long} Delta."), (4, f"Epsilon. {long} Zeta.")]
    rng = np.random.default_rng(1)
    rows += [(10 + i, " ".join(rng.choice(["A b.", "C d e.", "F.", "G h i j."], int(rng.integers(1, 12))))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in substring.dedup(df, substring.EXACT).collect()}
    assert got[1] == rows[0][1] and got[2] == "Beta opens now. Other end." and got[3] == rows[2][1] and got[4] == rows[3][1]
    assert {r.doc_id: r.clean_text for r in substring.dedup(df.where("doc_id < 10")).collect()}[2] == rows[1][1]
    seen, want = {}, {}
    for i, text in rows:  # in the order of ids
        parts = [t[2] for t in substring.sentences(text)]
        gone = set()
        for a in range(len(parts) - 2):
            key = tuple(parts[a : a + 3])
            doc, at = seen.setdefault(key, (i, a))
            if doc != i or at + 3 <= a:
                gone |= {a, a + 1, a + 2}
        want[i] = [x for a, x in enumerate(parts) if a not in gone]
    assert {i: [t[2] for t in substring.sentences(x)] for i, x in got.items()} == want
    assert substring.repeated_runs(df.where("doc_id < 10"), substring.EXACT).count() == 1 and substring.repeated_runs(df.where("doc_id < 5")).count() == 1


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels)
    got = toxicity.score(docs, grammar).join(labels, "doc_id").collect()
    clean = [r for r in got if not r.toxic]
    assert sum(r.score >= 0.3 for r in clean) <= 0.02 * len(clean)
    assert sum(r.score >= 0.3 for r in got if r.toxic) >= 0.55 * sum(r.toxic for r in got)
    out = toxicity.score(odd, toxicity.Grammar(frozenset(), frozenset())).collect()
    assert toxicity.score(empty, toxicity.Grammar(frozenset(), frozenset())).count() == 0
    assert {r.doc_id: r.score for r in out}[8] > 0.5 and all(0 <= r.score <= 1 for r in out)
    none = toxicity.learn(empty, labels.limit(0))
    assert none.weights == tuple(toxicity.PRIOR)
    tag = none.tagger()
    # isolated, loose, targeted, negated, reported, threat
    assert none.events("He said you are an idiot. You are not stupid. You moron! trash", tag)[0] == [1, 0, 1, 1, 1, 0]
    assert none.events("I will kill you. They kill time never. Some idiot sat there", tag)[0] == [0, 1, 0, 0, 0, 1]


def test_toxicity_clauses(spark):
    sf = "/root/testdata/sf0.1"
    grammar = toxicity.learn(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    tag = grammar.tagger()
    score = lambda t: grammar.score(t, tag)
    for text in ("You are not stupid.", "He said you are an idiot.", "idiot", "He said: you idiot. She called him a moron. They wrote that she is scum.", "I will never kill you.", "She said he would kill you.", "", "A plain sentence."):
        assert score(text) < toxicity.THRESHOLD, text
    for text in ("I will kill you.", "You are an idiot.", "You are not tall and not old but in all these years you are an idiot."):
        assert score(text) >= toxicity.THRESHOLD, text
    assert score("I will kill you. I will hurt you and burn your house.") > score("I will kill you.")


def test_toxicity_single_insults(spark):
    """One insult without a target never decides, however long or short the text; negated and reported ones neither; repeated and targeted ones do."""
    sf = "/root/testdata/sf0.1"
    grammar = toxicity.learn(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    tag = grammar.tagger()
    score = lambda t: grammar.score(t, tag)
    for text in ("Please take out the trash on Monday.", "The clown performed at the circus for the children.", "idiot today", "He is no idiot.", "Nobody is an idiot.", "The mayor was accused of being a worthless clown.", "According to the paper he is a moron.", "Without an idiot the play ends early."):
        for longer in (text, f"{'Plain words stand here. ' * 50}{text}"):
            assert score(longer) < toxicity.THRESHOLD, text
    for text in ("Only an idiot like you believes it.", "What a stupid worthless moron.", "You clown.", "A moron came. Later another idiot came."):
        assert score(text) >= toxicity.THRESHOLD, text


def test_composed_machine_against_plain():
    """The composed table against the three machines run one after another."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        word = [*rng.choice(list(toxicity.CLASSES[:-1]), 30, p=[0.4, 0.15, 0.1, 0.1, 0.1, 0.08, 0.07]).tolist(), "b"]
        word = [x if rng.random() > 0.1 else "b" for x in word]
        stream = word
        for machine, state in ((toxicity.NEGATION, (0,)), (toxicity.REPORT, (0,)), (toxicity._clause, (0, 0, 0, 0))):
            out = []
            for x in stream:
                state, y = machine(state, x)
                out.append(y)
            stream = out
        state, got = 0, []
        for x in word:
            i = toxicity.CLASSES.index(x)
            got.append(toxicity._OUT[state][i])
            state = toxicity._NEXT[state][i]
        assert got == stream


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries()["op3_toxicity"](spark, sf).where("held_out").collect() if r.doc_id in labels]
    toxic = [r.predicted for r in held if labels[r.doc_id]]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.87 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_evidence():
    evidence = toxicity._evidence
    assert evidence(1, 9, 0.1) == evidence(0, 5, 0.1) == 0
    assert evidence(5, 0, 0.1) == pytest.approx(5 * np.log(10))
    assert 0 < evidence(5, 2, 0.1) < evidence(5, 1, 0.1) < evidence(6, 1, 0.1)
    # Copies share all signatures, other texts none.
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    assert toxicity._signatures(a) == toxicity._signatures(a.upper()) and not set(toxicity._signatures(a)) & set(toxicity._signatures(b))
    assert len(toxicity._signatures("")) == toxicity.SIGNATURES


def test_knn(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 0) for i in range(3000)]
    rows += [(3000 + i, [0.5] * 8, 0) for i in range(400)] + [(4000, None, 0), (4001, [1.0, None], 0), (4050, [float("nan")] * 8, 0), (4100, [0.25, 0.5], 0), (4101, [0.5, 0.5], 0), (None, [0.1] * 8, 0), (50, rows[50][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fine = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    expected = []
    for q, v in {i: v for i, v in fine if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = knn.top_k(df).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert knn.top_k(df.limit(0)).count() == 0


def test_knn_copies_of_the_query(spark):
    rows = [(50, [1.0, 1.0])] * 7 + [(i, [0.9, 0.9 + i / 1000]) for i in range(1, 6)] + [(i, [-1.0, -i / 100]) for i in range(100, 140) if i % 50]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 50").collect()
    best = sorted((-sum(256 * int(np.floor(256 * c)) for c in v), i) for i, v in rows if i != 50)[:5]
    assert sorted(map(tuple, got)) == [(50, k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
    <div class="ad">Buy this wonderful thing now, it is cheap and good for you and everyone</div>
    <article><header><h1>A &amp; B</h1></header><p>First   paragraph &lt;here&gt; with <b>bold</b> words<br>and more.<p>Second one &copy; 2 &nbsp;x.</p><aside>Related things</aside>
    <script>var x = "</p>";</script><!-- <p>no</p> --><div class="comments"><p>Nice article, I liked it very much indeed!</p></div></article><form><p>Subscribe to our letter</p></form><footer>All &middot; rights</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "v", "", 3), (3, "v", "<p>cut off &am", 3), (None, "w", "<article><p>" + "long " * 100_000, 1)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    by = {(r.page_id, r.n_chars): r.text for r in got}
    assert "A & B\nFirst paragraph <here> with bold words and more.\nSecond one © 2 x." in by.values()
    assert len(got) == 5 and by[2, 0] == "" and any(r.page_id is None and r.n_chars == 499_999 for r in got)


def test_html_keeps_main_text():
    tree = html.trained_tree()
    prose = " ".join(f"word{i}" for i in range(40))
    article = f"<article><h1>Title here</h1><p>{prose}</p></article>"
    whole = f"Title here\n{prose}"
    pages = [f"<html><head><title>x</title><body>{article}"]
    pages += [f"<html><body>{x}{article}</body></html>" for x in ("<title>x<p></p>", "<svg><path d=a>", "<div><svg><path></div>", "<button>Menu", "<div><button>Menu</div>", "<div><button>Menu<button>More</button></div>", "<noscript>", "<div><noscript>no</div>", "<template><article><p>silent</p></article></template>", "<svg><foreignObject><div>no</div></foreignObject></svg>")]
    pages += [f'<div class="page with-sidebar">{article}</div>', f'<div id="content-form">{article}</div>', f"<form>{article.replace('article', 'main')}</form>"]
    pages += [f'<article><div class="entry-header"><h1>Title here</h1></div><p>{prose}</p></article>']
    assert [html.main_text(p, tree) for p in pages] == [whole] * len(pages)
    assert html.main_text(f"<aside>{article}</aside><nav>{article}</nav>", tree) == ""


def test_html_pages():
    tree = html.trained_tree()
    prose = lambda n, k="w": " ".join(f"{k}{i}" for i in range(n))
    links = lambda n: "".join(f"<a href=x>link{i} </a>" for i in range(n))
    main = f"T\n{prose(40)}\n{prose(30, 'z')}"
    article = f"<article><h1>T</h1><p>{prose(40)}</p><p>{prose(30, 'z')}</p></article>"
    plain = f"<h1>T</h1><p>{prose(40)}</p><p>{prose(30, 'z')}</p>"
    pages = [f"{article}<footer>{links(9)}</footer>", f"{plain}<div>{links(9)}</div>", f"<div class=advert>{prose(60, 'ad')}</div><ul class=menu><li>{links(1)}<li>{links(1)}</ul>{article}", f"{article}<div>{links(14)}</div>"]
    pages += [f'<div class="{x}">{plain}</div>' for x in ("page-header-wrap", "related-work", "with-sidebar", "form")]
    pages += [f"<form id=f><div class=menu>{links(2)}</div>{plain}<div id=footer>foot text</div></form>", f'{article}<div class="comment-list"><p>{prose(50, "c")}</p><p>{prose(90, "c")}</p></div>']
    pages += [f'<div id="cookie-banner">{prose(30, "k")}</div><main>{plain}</main><div class="sidebar-left"><p>{prose(50, "s")}</p></div>', article.replace("</article>", f"<p hidden>{prose(30, 'h')}</p><p style='display:none'>x y</p></article>")]
    pages += [f"<select><option>a{article}", f"{article}<aside>{prose(80, 'a')}</aside>", f"<div role=navigation>{prose(30, 'n')}</div><div role=main>{plain}</div>"]
    assert [html.main_text(p, tree) for p in pages] == [main] * len(pages)


PROSE = lambda n, k="w": " ".join(f"{k}{i}" for i in range(n)) + "."
CHROME_FORMS = ["<aside><h3><a>Related story</a></h3></aside>", "<footer><h4><a>Company</a></h4></footer>", "<nav><h2><a>Site Home</a></h2></nav>", "<header><h1><a>My Site</a></h1></header>"]
CHROME_FORMS += [f"<{x}><p>{PROSE(30, 'c')}</p></{x.split()[0]}>" for x in ("article class='comment-body'", "div class='comment-body'", "div id=disqus_thread", "section id=responses", "div class=discussion", "div id=cookie-consent", "div id=gdpr", "div class=footer-widgets", "div class=sidebar-primary", "div class=site-info")]
CHROME_FORMS += [f"<div class=teaser><h3><a>x y</a></h3><p>{PROSE(20, 'k')}</p></div>"]


@pytest.mark.parametrize("form", CHROME_FORMS)
def test_html_chrome_forms(form):
    tree = html.trained_tree()
    for around in ("article", "div"):
        main = f"<{around}><h1>Title here</h1><p>{PROSE(40)}</p><p>{PROSE(30, 'z')}</p></{around}>"
        for page in (form + main, main + form):
            assert html.main_text(page, tree) == f"Title here\n{PROSE(40)}\n{PROSE(30, 'z')}"


def test_html_main_forms():
    tree = html.trained_tree()
    refs = "<h2>References</h2><ol><li>Some author, <a>title of the paper</a>, 1999.</li><li>Other author, <a>a title</a>, 2001.</li></ol>"
    forms = {
        f"<div class=post-header><h1>Title here</h1><p>By A on Monday</p></div><p>{PROSE(40)}</p>": ["Title here", "By A on Monday", PROSE(40)],
        f"<article><h1>T</h1><p class=widget>{PROSE(30)}</p><p>{PROSE(20, 'b')}</p></article>": ["T", PROSE(30), PROSE(20, "b")],
        f"<article><h1>T</h1><p>{PROSE(30)}</p><p><a href=x>{PROSE(9, 'l')}</a></p><p>{PROSE(20, 'b')}</p></article>": ["T", PROSE(30), PROSE(9, "l"), PROSE(20, "b")],
        f"<article><h1>T</h1><p>{PROSE(30)}</p>{refs}</article>": ["T", PROSE(30), "References", "Some author, title of the paper, 1999.", "Other author, a title, 2001."],
        f"<article><p>foo<script>x</script>bar<style>y</style>s {PROSE(20)}</p></article>": [f"foobars {PROSE(20)}"],
    }
    assert {page: html.main_text(page, tree).split("\n") for page in forms} == forms


def test_html_held_out():
    right, n = html.held_out()
    assert n > 5000 and right > 0.97
    used = lambda t: set() if isinstance(t, int) else {html.FEATURES[t[0]]} | used(t[2]) | used(t[3])
    assert {"words_after", "links"} & used(html.trained_tree())


def plain_blocks(page):
    """Text of blocks and their link words by the standard parser, for well-formed pages."""
    from html.parser import HTMLParser

    out, text, linked, depth = [], [], [], [0, 0]

    class P(HTMLParser):
        def flush(self):
            t = " ".join("".join(text).split())
            if t:
                out.append((t, len("".join(linked).split())))
            text.clear()
            linked.clear()

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCKS:
                self.flush()
            elif tag in html.SILENT:
                depth[0] += 1
            elif tag == "a":
                depth[1] += 1
            elif tag == "br":
                text.append(" ")

        def handle_endtag(self, tag):
            if tag in html.BLOCKS:
                self.flush()
            elif tag in html.SILENT:
                depth[0] -= 1
            elif tag == "a":
                depth[1] -= 1

        def handle_data(self, data):
            if not depth[0]:
                text.append(data)
                if depth[1]:
                    linked.extend((data, " "))

    p = P(convert_charrefs=True)
    p.feed(page)
    p.close()
    p.flush()
    return out


def test_html_blocks_against_plain(spark):
    rng = np.random.default_rng(9)

    def element(depth):
        kind = rng.choice(["text", "b", "a", "script", "p", "div", "ul", "article", "nav", "br", "h2", "table"], p=[0.3, 0.08, 0.12, 0.05, 0.13, 0.08, 0.05, 0.04, 0.04, 0.03, 0.05, 0.03])
        if kind == "text" or depth > 4:
            return " ".join(rng.choice(["one", "two &amp; three", "four&nbsp;five", "&lt;six&gt;", "\n seven  "], int(rng.integers(1, 5))))
        if kind == "br":
            return "<br>"
        if kind == "script":
            return "<script>var t='<p>no</p>';</script>"
        inner = "".join(element(9 if kind in ("p", "a", "b", "h2") else depth + 1) for _ in range(int(rng.integers(1, 4))))
        return f"<ul><li>{inner}</li></ul>" if kind == "ul" else f"<table><tr><td>{inner}</td></tr></table>" if kind == "table" else f"<{kind} class='x'>{inner}</{kind}>"

    pages = ["<html><body>" + "".join(element(0) for _ in range(8)) + "</body></html>" for _ in range(300)]
    pages += [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages:
        if "<br><p>" not in page or "<b>" not in page:  # the parser keeps what authors left open
            assert [(b[0], b[2]) for b in html.blocks(page)] == plain_blocks(page)


def test_license(odd, empty):
    got = {(r.doc_id, r.n_words): r for r in license.scan(odd).collect()}
    assert license.scan(odd).count() == odd.count() and license.scan(empty).count() == 0
    row = next(r for (i, _), r in got.items() if i == 9)
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (2, 0, 3, "cc-by,reserved")
    assert next(r for (i, _), r in got.items() if i == 0).labels == ""


def test_license_base_against_plain(docs):
    expected = []
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        at = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
        places = [i for i, _ in at]
        expected.append((r.doc_id, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    got = license.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_license_labels(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any third person obtaining a copy of this software", "the license of the public"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in license.scan(df).orderBy("doc_id").collect()] == ["apache", "mit", "cc-by,cc-by-nc", "gpl", "mit", ""]


def test_license_order(spark):
    text = dict((label, t) for label, t in license.TEMPLATES if t.startswith("permission"))["mit"]
    words = text.split()
    rng = np.random.default_rng(3)
    pairs = [" ".join(words[i : i + 2]) for i in rng.permutation(len(words) - 1)]
    texts = [text, text.replace("granted", "here granted now"), " x y ".join(pairs), " ".join(rng.permutation(words)), f"{text} {text}", f"of this {text}", " far away ".join(" ".join(words[i : i + 2]) for i in range(len(words) - 1))]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "mit", "", "", "mit", "mit", ""] and [len(r.spans) for r in got] == [1, 1, 0, 0, 2, 1, 0]
    assert got[0].score == got[4].score == got[5].score == 1.0 and 0.8 < got[1].score < 1.0


def test_empty_tables(empty):
    assert language.identify(empty, language.Automata({"a": "some text"})).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0 and substring.remove_repeats(empty).count() == 0
    assert html.extract(empty.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "h AS text")).count() == 0


def test_sql_of_queries(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for name, sql in oracle_sql().items():
        a, b = queries()[name](spark, SF).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(map(tuple, a[b.columns].values.tolist())) == sorted(map(tuple, b.values.tolist()))


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    more = odd.union(odd.selectExpr("doc_id + 100", "concat(text, ' ', substring(repeat('some more words stand here ', 3), 1, 60), doc_id)", "lang", "source", "n_chars", "h", "row", "clean_text", "_h", "fp"))
    for k, df in enumerate((odd, more, empty)):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").toPandas()
        assert (len(out) == 0) == (df is empty)
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        before = after.cache()
    kept = quality.apply_policy(quality.ledger(docs)).where("kept")
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() == kept.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
