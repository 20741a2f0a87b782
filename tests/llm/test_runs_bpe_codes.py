"""Periodic runs, byte-level BPE and vector codes against plain versions, and on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, codes, runs
from graphloom.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, row string, ids string, no int, k int, n_words string, runs int, collapsed int, final int"
sha = lambda b: hashlib.sha256(b).hexdigest()


# -- runs


def plain_runs(a, least=6, times=4):
    n, out = len(a), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if a[i] != a[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and a[i] == a[i + q]:
                i += 1
            length = i + q - start
            # A stretch that a smaller period holds as well was found before.
            if length >= max(least, times * q) and not any(s <= start and start + length <= s + m for s, m in out if out[s, m] < q):
                out[start, length] = q
    return sorted((s, m, q) for (s, m), q in out.items())


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=9))
def test_find_runs(parts):
    a = [x for part, n in parts for x in part * n]
    assert runs.find_runs(np.array(a, np.int64)) == plain_runs(a)


def test_find_runs_nested_and_long():
    rng = np.random.default_rng(4)
    a20 = [1] * 20
    cases = [(a20 + [2]) * 9, (a20 + [2] + [1] * 19 + [2]) * 6, ([1, 2] * 8 + [3]) * 7, [1] * 5, [1] * 6, [1, 2] * 4, ([1] * 64 + [2] * 64) * 5]
    for _ in range(60):
        base = rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(1, 60))).tolist()
        cases.append(rng.integers(0, 3, int(rng.integers(0, 20))).tolist() + base * int(rng.integers(1, 8)) + base[: int(rng.integers(0, len(base)))] + rng.integers(0, 3, 5).tolist())
    for a in cases:
        assert runs.find_runs(np.array(a, np.int64)) == plain_runs(a)
    # Work stays in proportion to the length: these take seconds at most.
    assert runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    long = np.concatenate([np.zeros(30_000, np.int64), [1]])
    assert (0, 5 * 30_001, 30_001) in runs.find_runs(np.tile(long, 5))


def plain_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    return (
        doc_id, len(found), start, length, period, best and 1000 * length // period,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()),
    )


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries()["op11_runs"](spark, SF).select(RUN_COLUMNS)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(plain_op11(d.doc_id, d.text) for d in docs)
    assert sum(1 for r in rows if r[1]) > 5


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t ", "one", "a b " * 9, "a " * 20, "x\x00y \U0001f600 é " * 5, "don't  we'll\n\n go", "w" * 90_000, " " * 70_000 + "end", "".join(chr(97 + i % 26) + (" " if i % 7 == 0 else "") for i in range(120_000)), "<|endoftext|> 123 abc"]
    rows = [(i, t, "r", "i", i, 1, "n", 2, 3, 0) for i, t in enumerate(texts)] + [(None, "a b " * 9, None, None, None, None, None, None, None, None), (4, "a b " * 9, "r", "i", 4, 1, "n", 2, 3, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_runs_odd_rows(spark, odd, tmp_path):
    got = runs.collapse_runs(odd, ["doc_id", "row"]).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_words for i in range(4)] == [0, 0, 0, 1] and by_id[1].collapsed == "" and by_id[0].collapsed == ""
    assert [tuple(x) for x in by_id[4].runs] == [(0, 18, 2)] and by_id[4].collapsed == "a b" and by_id[None].collapsed == "a b"
    assert runs.collapse_runs(odd.limit(0), ["doc_id"]).count() == 0
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in queries()["op11_runs"](spark, str(tmp_path)).select(RUN_COLUMNS).collect()]
    assert Counter(rows) == Counter(plain_op11(d.doc_id, d.text) for d in odd.collect())


# -- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op12_query(spark, encoding):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def plain(d):
        ids = encoding.encode_ordinary(d.text or "")
        return d.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((d.text or "").encode())

    got = queries()["op12_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string"]
    assert Counter(map(tuple, got.collect())) == Counter(map(plain, docs))


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (97, 31), (40, 12)])
def test_bpe_chunks(spark, odd, encoding, chunk, overlap):
    rng = np.random.default_rng(chunk)
    parts = ["'ll", "'l", "'", "l", "lx", " ", "  ", "\n", "\t ", "7", "78", "é", "漢", "\U0001f600", "word", "!?", "'re", "x" * 30, " " * 25, "-" * 45]
    texts = ["".join(rng.choice(parts, int(rng.integers(20, 200)))) for _ in range(150)]
    df = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string") if chunk < 100 else odd
    got = bpe.encode(df, PATH, public_tokenizers.PATTERN, ["doc_id", "text"], chunk=chunk, overlap=overlap)
    back = bpe.decode(got, PATH, ["doc_id", "text", "ids"]).collect()
    assert len(back) == df.count()
    for r in back:
        plain = [i for m in bpe.regex.findall(public_tokenizers.PATTERN, r.text or "") for i in encoding._encode_single_piece(m)]
        assert r.ids == plain and bytes(r.decoded) == (r.text or "").encode()


def test_stitch_takes_up_after_lost_borders():
    """Long runs of one class leave neighbours without a shared boundary; cuts still are true boundaries."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "x" * 70, " " * 60, "'s", "1"], int(rng.integers(20, 60))))
        chunk, overlap = 50, 20
        starts = list(range(0, max(1, len(text) - overlap), chunk))
        heads, tails = [], []
        for k, s in enumerate(starts):
            final = k == len(starts) - 1
            piece = text[s:] if final else text[s : s + chunk + overlap]
            at = bpe.boundaries(piece, public_tokenizers.PATTERN)
            last = len(piece) - (0 if final else bpe.MARGIN)
            heads.append([s + x for x in at if x < overlap and x <= last])
            tails.append([] if final else [s + x for x in at if chunk <= x <= last])
        cuts = bpe.stitch(text, heads, tails, public_tokenizers.PATTERN)
        true = set(bpe.boundaries(text, public_tokenizers.PATTERN))
        assert cuts[0] == 0 and cuts == sorted(set(cuts)) and true.issuperset(cuts)
        assert [m for a, b in zip(cuts, cuts[1:] + [len(text)]) for m in bpe.regex.findall(public_tokenizers.PATTERN, text[a:b])] == bpe.regex.findall(public_tokenizers.PATTERN, text)


def test_bpe_empty_and_null(spark, odd):
    assert bpe.encode(odd.limit(0), PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, None), (2, [5, None, 6]), (3, [])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH, ["doc_id"]).collect()}
    table = {v: k for k, v in bpe._ranks(PATH).items()}
    assert got == {1: None, 2: bytearray(table[5] + table[6]), 3: bytearray()}


# -- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(code, error) of each (vec_id, vector), and the codebooks; every distance measured in whole numbers."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    w = x.shape[1] // parts
    books = [x[order[:entries], p * w : (p + 1) * w].copy() for p in range(parts)]
    for k in range(rounds + 1):
        nearest = []
        for p in range(parts):
            part = x[:, p * w : (p + 1) * w]
            d = ((part[:, None, :] - books[p][None]) ** 2).sum(2)
            nearest.append((d.argmin(1), d.min(1)))
            if k < rounds:
                for e in range(len(books[p])):
                    mine = part[nearest[p][0] == e]
                    if len(mine):
                        books[p][e] = mine.sum(0) // len(mine)
    return ["".join(f"{nearest[p][0][i]:02x}" for p in range(parts)) for i in range(len(rows))], [sum(int(nearest[p][1][i]) for p in range(parts)) for i in range(len(rows))], np.stack(books)


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "few", "large"])
def test_codes_against_plain(spark, kind):
    rng = np.random.default_rng(11)
    n = 40 if kind == "few" else 900
    v = rng.normal(size=(n, 8)).astype(np.float32)
    if kind == "grid":  # many equal distances
        v = (rng.integers(-2, 3, (n, 8)) / 1024).astype(np.float32)
    if kind == "copies":
        v[200:] = v[rng.integers(0, 20, n - 200)]
    if kind == "large":
        v *= 30_000
    rows = [(int(i), [float(c) for c in v[i]], "a" if i % 3 else None) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, label string").repartition(3)
    got, books = codes.compress(df, ["vec_id", "label"], "vec_id", "v")
    out = {r.vec_id: (r.code.hex(), r.error, r.label_error) for r in codes.with_group_sums(got, "label", "error", "label_error").collect()}
    code, error, plain = plain_codes([(i, x) for i, x, _ in rows])
    assert np.array_equal(books, plain)
    sums = Counter()
    for (_, _, label), e in zip(rows, error):
        sums[label] += e
    assert out == {i: (c, e, sums[label]) for (i, _, label), c, e in zip(rows, code, error)}


def test_bounds_prune():
    """From the second round on, most distances are not measured, and bounds hold what they promise."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(64, 16)) * 4
    x = np.floor(1024 * (centres[rng.integers(0, 64, 3000)] + 0.3 * rng.normal(size=(3000, 16)))).astype(np.int64)
    books = x[:64].copy()
    before = codes.Round(books[None].copy(), None)
    entry, upper, levels = codes.first_bounds(x, before, 0)
    for _ in range(4):
        for e in range(64):
            if (entry == e).any():
                books[e] = x[entry == e].sum(0) // (entry == e).sum()
        now = codes.Round(books[None].copy(), before)
        entry, upper, levels, measured = codes.next_bounds(x, entry, upper, levels, now, 0)
        true = np.sqrt(((x[:, None] - books[None]) ** 2).sum(2).astype(float))
        assert np.array_equal(entry, ((x[:, None] - books[None]) ** 2).sum(2).argmin(1))
        own = true[np.arange(3000), entry]
        assert (upper >= own * (1 - 1e-9)).all()
        lower = upper[:, None] * (1 - 4 * codes.SLACK) + levels * now.step[0] - codes.SLACK
        lower[np.arange(3000), entry] = 0
        assert (lower <= true).all()
        before = now
    assert measured < 3000 * 64 / 8


def test_codes_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -1.0, 2.0, 3.0], "a", "x"), (2, None, "a", "x"), (3, [1.0, None, 1.0, 1.0], "a", None), (4, [nan] * 4, "b", "x"), (5, [inf, 0.0, 0.0, 0.0], "b", "x"), (None, [0.5, 1.0, -1.0, 2.0, 3.0], None, "x"), (1, [0.5, 1.0, -1.0, 2.0, 3.0], None, "x"), (7, [], "c", "x"), (8, [3e38, -3e38, 0.0, 1.0], "c", "x"), (9, [1.0], "a", "x")]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, label string, row string")
    got, books = codes.compress(df, ["vec_id", "label", "row"], "vec_id", "v")
    out = codes.with_group_sums(got, "label", "error", "label_error").collect()
    assert Counter(r.vec_id for r in out) == Counter([1, 1, None, 7, 8, 9])
    assert books.shape == (4, 6, 2) and all(r.error == 0 for r in out)
    none, empty = codes.compress(df.limit(0), ["vec_id"], "vec_id", "v")
    assert none.count() == 0 and empty.shape[1] == 0
    df.limit(0).selectExpr("vec_id", "v as embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries()["op13_codes"](spark, str(tmp_path)).count() == 0
