"""Quality rules as a bitmask ledger. DataFrame functions only.

Every rule is evaluated once per document. The ledger stores measurements and
one failure bit per rule; policies are masks over those bits, so a policy can
be versioned, replayed or ablated without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SPACE = "[ \\t\\n\\x0B\\f\\r]+"

#: name -> condition that fails a document, over the ledger's measurements. The place in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "20 * n_symbols > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", BASE | BITS["symbols"]),
    "v2": Policy("v2", BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["word_length"]),
}
CURRENT = "v2"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, measurements and ``fail_bits`` of every row of ``docs``.

    Null text has no words. A line is what stands between ``\\n``; it counts
    as repeated if it has a word and equals an earlier line of the text.
    Repeated rows give repeated results; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", "t", _words(F.col("t")).alias("w"))
    windows = F.expr(f"case when size(w) < {WINDOW} then cast(array() as array<bigint>) else transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64(" + ", ".join(f"w[i + {k}]" for k in range(WINDOW)) + ")) end")
    rows = rows.select(
        "doc_id",
        "w",
        windows.alias("h"),
        F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit("[^ \\t\\n\\x0B\\f\\r]"))).alias("lines"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
    )
    # Windows that occur again stand side by side once sorted; each covers 5 words, less what the next one covers.
    starts = F.expr(
        "case when size(array_distinct(h)) = size(h) then cast(array() as array<int>) else"
        " array_sort(transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))), s -> transform("
        "filter(sequence(0, size(s) - 1), k -> (k > 0 and s[k].x = s[greatest(k - 1, 0)].x) or (k < size(s) - 1 and s[k].x = s[least(k + 1, size(s) - 1)].x)),"
        " k -> s[k].i))[0]) end"
    )
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), starts.alias("s"))
    covered = F.expr(f"aggregate(s, struct(cast(0 as bigint) as n, cast(-{WINDOW} as int) as last), (a, x) -> struct(a.n + least({WINDOW}, x - a.last) as n, x as last), a -> a.n)")
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    bits = F.lit(0)
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)))
    out = rows.withColumn("fail_bits", bits)
    # A filter on the result must not be moved below what it filters by: it would make the words anew for every window.
    return out.select(F.explode_outer(F.array(F.struct(*out.columns))).alias("m")).select("m.*")


def apply_policy(found: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    mask = POLICIES[version].mask | BASE
    return found.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(found: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents rejected, and those kept if that rule were dropped.

    Masks are counted first, so what follows reads one row per mask.
    """
    masks = found.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plans = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).alias("mask"), F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for p in POLICIES.values() for name, bit in BITS.items() if p.mask & bit])
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    rows = masks.select(F.explode(plans).alias("p"), "fail_bits", "n").select("p.*", "fail_bits", "n")
    return rows.groupBy("version", "rule").agg(F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"), F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_by_this_rule_alone"))


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """``docs`` without the rows that the policy rejects, evaluated in place without a join.

    Null and empty texts have too few words and go. Rows with a null or
    repeated doc_id are judged one by one, texts of any length whole; columns
    pass through, whatever their names, and an empty table gives an empty one.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    return apply_policy(ledger(packed), version).where("kept").select("doc_id.*")
