"""License scans by diagonal voting.

All rolling hashes of two and of three words of the documents meet the grams
of the templates in one join: sentences by two words, whole notices by three. A match votes for the diagonal on which document and
template run in parallel: the document word at which the template would begin.
Neighbouring diagonals of a template, which words put in or left out make of
one, are merged, never more than SLACK words apart in all. The span is verified
by the longest run of grams that stand in the template's order, each once;
short templates must stand whole, and of a notice the words that tell it from
its likes. A verified span within a longer one of another template is left out,
so the stricter license is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Templates of more words than LONG are cut in grams of three words, others of two; those of up to SHORT words stand whole or not at all.
LONG = 20
SHORT = 8
#: Share of a template's grams that verifies a span, and how far apart the diagonals of a span may be.
VERIFIED = 0.75
SLACK = 3

# Base phrases and their labels, which match as they stand.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Templates of the method and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "licensed under the gnu general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
]
# Notices of well-known licenses; what stands in brackets must be there whole.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("boost", "permission is hereby granted free of charge to any [person or organization obtaining] a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("apache", "licensed under the [apache license] version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the [gnu affero general public license] as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl", "this source code form is subject to the terms of the [mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("epl", "this program and the accompanying materials are made available under the terms of the [eclipse public license] which accompanies this distribution and is available at"),
]
# Names of licenses, and the words of their identifiers.
NAMES = {
    "apache": ["apache license 2 0", "apache license version 2 0"], "mit": ["the mit license"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "lgpl": ["gnu lesser general public license"], "agpl": ["gnu affero general public license"],
    "mpl": ["mozilla public license"], "epl": ["eclipse public license"], "boost": ["boost software license"], "isc": ["the isc license"], "cc0": ["cc0 1 0"],
}
IDENTIFIERS = {"apache": ["apache 2 0"], "mit": ["mit"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 3 0"], "mpl": ["mpl 2 0"], "epl": ["epl 2 0"], "boost": ["bsl 1 0"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"]}
PARTS = {"by": ["attribution"], "nc": ["noncommercial", "non commercial"], "sa": ["sharealike", "share alike"], "nd": ["noderivatives", "no derivatives"]}
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands before the grams of each document, so one with no match keeps a row.
_NONE = -1


def method_templates() -> list[tuple[str, str]]:
    """``(label, text)`` of all templates but the base phrases, names and identifiers spelled out."""
    out = [*TEMPLATES, *NOTICES]
    out += [(label, name) for label, names in NAMES.items() for name in names]
    out += [(label, f"spdx license identifier {name}") for label, names in IDENTIFIERS.items() for name in names]
    for code in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"):
        label = f"cc-{code.replace(' ', '-')}"
        for name in dict.fromkeys(" ".join(PARTS[part][k % len(PARTS[part])] for part in code.split()) for k in (0, 1)):
            out += [(label, f"creative commons {name}"), (label, f"licensed under a creative commons {name}")]
        if code != "by":  # that one is a base phrase
            out.append((label, f"cc {code}"))
    return list(dict.fromkeys(out))


def _templates() -> tuple[list[tuple], list[tuple]]:
    """``(template, label, base, grams, place, words...)`` rows, one for each gram, and ``(template, words a gram, least share, key places)``."""
    grams, rules = [], []
    for t, (label, text, base) in enumerate([*[(v, k, True) for k, v in BASE.items()], *[(label, text, False) for label, text in method_templates()]]):
        words, held, inside = [], [], False
        for w in text.split():
            inside = inside or w.startswith("[")
            words.append(w.strip("[]"))
            held.append(inside)
            inside = inside and not w.endswith("]")
        k = 3 if len(words) > LONG else 2
        n = len(words) - k + 1
        for i in range(n):
            grams.append((t, label, base, n, i, *words[i : i + k], *[None] * (3 - k)))
        rules.append((t, k, 1.0 if len(words) <= SHORT else VERIFIED, [i for i in range(n) if all(held[i : i + k])]))
    return grams, rules


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and the verified ``spans``.

    Words are runs of letters, digits and all characters beyond ASCII of the
    lower-cased text; null text has none. ``n_base`` counts the places of all
    base phrases, ``first_word`` and ``last_word`` their smallest and largest
    start. The score is the largest share of a template found in order. Rows are
    told apart by id and text, so repeated rows give repeated results; an empty
    table gives none. Texts of any length are read whole, null ids pass and
    other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.filter(F.split(text, _SPLIT), lambda w: w != "").alias("w"))
    # Two words first, then three: the n-th entry and those after it are of three words, counted from the first.
    roll = lambda k, of: f"case when size(w) < {k} then cast(array() as array<bigint>) else transform(sequence(0, size(w) - {k}), i -> xxhash64({of})) end"
    grams = F.concat(F.expr(roll(2, "w[i], w[i + 1]")), F.expr(roll(3, "w[i], w[i + 1], w[i + 2]")))
    cut = rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit(_NONE).cast("long")), grams).alias("g"))
    # The templates' grams are a fixed handful of rows.
    cuts, rules = _templates()
    table = spark.createDataFrame(cuts, "t int, label string, base boolean, grams int, place int, a string, b string, c string")
    table = table.select("t", "label", "base", "grams", "place", F.when(F.col("c").isNull(), F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "b", "c")).alias("h"))
    rules = F.broadcast(spark.createDataFrame(rules, "t int, k int, least double, keys array<int>"))
    none = spark.createDataFrame([(_NONE, "", False, 1, 0, _NONE)], "t int, label string, base boolean, grams int, place int, h long")
    # The outer form: for the inner one Spark would put a filter on the grams below, which makes words anew for each gram.
    hits = cut.select("doc_id", "th", "n_words", F.posexplode_outer("g").alias("at", "h")).join(F.broadcast(table.union(none)), "h").drop("h")
    hits = checkpoint(hits.withColumn("at", F.when(F.col("at") < F.col("n_words"), F.col("at") - 1).otherwise(F.col("at") - F.col("n_words")).cast("int")))
    every = hits.where(F.col("t") == _NONE).select("doc_id", "th", "n_words")
    row = ["doc_id", "th"]
    votes = hits.where(F.col("t") != _NONE).select(*row, "t", "label", "base", "grams", "place", "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    lines = votes.where("base").groupBy(*row, "t", "label", "base", "grams", "diagonal").agg(F.collect_set("place").alias("places"))
    # Base phrases: every gram on one diagonal.
    base = lines.where(F.col("base") & (F.size("places") == F.col("grams")))
    # Templates: each diagonal with its neighbours up to SLACK on. A line of one text's matches is no longer than the text.
    order = Window.partitionBy(*row, "t").orderBy("diagonal")
    ahead = order.rangeBetween(0, SLACK)
    near = votes.where("not base").withColumn("n", F.count(F.lit(1)).over(ahead)).withColumn("met", F.when(F.col("n") >= 2, F.collect_list(F.struct("at", (-F.col("place")).alias("back"))).over(ahead)))
    near = near.select(*row, "t", "label", "grams", "diagonal", "place", "at", F.coalesce("met", F.array(F.struct("at", (-F.col("place")).alias("back")))).alias("met")).dropDuplicates([*row, "t", "diagonal"])
    # The longest run in order: for each place of the template the most grams, ending there, of a chain through earlier places and words.
    chain = F.expr(
        "aggregate(array_sort(array_distinct(met)), array_repeat(0, grams), (best, m) -> transform(best, (v, i) ->"
        " if(i = -m.back, greatest(v, 1 + coalesce(array_max(slice(best, 1, i)), 0)), v)), best -> array_max(best))"
    )
    ats = F.transform("met", lambda m: m["at"])
    whole = F.size(F.array_except("keys", F.transform("met", lambda m: -m["back"]))) == 0
    runs = near.join(rules, "t").select(*row, "label", "grams", "least", whole.alias("whole"), F.when(F.size("met") == 1, 1).otherwise(chain).alias("found"), F.array_min(ats).alias("start"), (F.array_max(ats) + F.col("k")).alias("end"))
    runs = runs.withColumn("share", F.col("found") / F.col("grams")).withColumn("sure", F.col("whole") & (F.col("share") >= F.col("least")))
    # A longer sure span around one begins before it, or with it and ends later.
    begin = Window.partitionBy(*row).orderBy("start")
    ends = F.when(F.col("sure"), F.col("end"))
    wider = (F.max(ends).over(begin.rangeBetween(Window.unboundedPreceding, -1)) >= F.col("end")) | (F.max(ends).over(Window.partitionBy(*row, "start")) > F.col("end"))
    named = F.col("sure") & ~F.coalesce(wider, F.lit(False))
    runs = runs.withColumn("named", named)
    alike = runs.select(*row, F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("base_label"), F.when(F.col("named"), F.col("label")).alias("label"), "share", F.when(F.col("named"), F.struct("label", "start", "end")).alias("span"))
    exact = base.select(*row, F.col("diagonal").alias("place"), F.col("label").alias("base_label"), "label", F.lit(1.0).alias("share"), F.struct("label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("grams") + 1).alias("end")).alias("span"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = exact.unionByName(alike).groupBy(*row).agg(
        F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"), joined("base_label").alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"), F.array_sort(F.collect_set("span")).alias("spans")
    )
    named = found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), *found.columns[2:])
    out = every.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
