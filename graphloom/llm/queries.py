"""The operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, html, knn, language, license, mixing, packing, quality, runs, simhash, substring, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return out.select("doc_id", F.col("clean_text").alias("text"), F.size("removed").cast("long").alias("n_spans"), gone.alias("chars_removed"), (F.size("removed") > 0).alias("has_repeat"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    automata = language.Automata(language.training_text(docs))
    out = language.identify(docs, automata)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % language.FOLDS == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, grammar)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == toxicity.HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents")).drop("spans")


def with_planted_run(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, by their id's CRC-32, goes round from some word on. Rows without an id, and texts without a word, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def planted(words):
        n = F.size(words).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (g % 8 + 3))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    changed = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise("")), 0)
    return docs.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.collapse_runs(with_planted_run(_table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumns({"best": longest, "lines": F.concat_ws("", lines)})
    length, period = -F.col("best.less"), F.col("best.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])
    out = bpe.decode(ids, path, ["doc_id", "ids"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compress(_table(spark, sf_dir, "embeddings"), ["vec_id", "label"], "vec_id", "embedding")
    out = codes.with_group_sums(out, "label", "error", "label_error")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_toxicity, op4_simhash, op5_topk, op6_quality, op7_mixing, op8_html, op9_packing, op10_license, op11_runs, op12_bpe, op13_codes)}


OP5_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), asked AS (
  SELECT vec_id, min(x) AS x FROM fine WHERE vec_id % 50 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM asked q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 5
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), windows AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS u(k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.r = w.r
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 20 * n_symbols > word_chars THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END) AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS INTEGER) AS fail_bits FROM b
"""


def _op13_sql() -> str:
    """Four rounds and the last assignment, each a table of its own."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
)""",
        """piece AS MATERIALIZED (
  SELECT r, vec_id, label, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x FROM kept, range(4) AS t(p)
)""",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c, list_inner_product(x, x) AS cc FROM piece WHERE r <= 256)",
    ]
    for k in range(5):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, b.p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + cc AS d FROM piece JOIN book{k} b ON b.p = piece.p) GROUP BY r, p
)""")
        if k < 4:
            steps.append(f"""mean{k} AS MATERIALIZED (
  SELECT p, e, list(f ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(y) / count(*)) AS f FROM (SELECT n.p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k} n JOIN piece ON piece.r = n.r AND piece.p = n.p) GROUP BY p, e, i
  ) GROUP BY p, e
)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e))")
    steps.append("coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY r)")
    steps.append("digest AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM book4))")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), digest"


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL, "op6_quality": OP6_SQL, "op13_codes": _op13_sql()}
