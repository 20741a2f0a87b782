"""Labels of license notices as they stand in files, changed notices, and texts that only sound like them."""

import random

from graphloom.llm import license

NOTES = [
    ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
    ("Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Creative Commons Attribution-Share Alike 3.0 Unported", "cc-by-sa"),
    ("Licensed under the Apache License 2.0", "apache"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("// SPDX-License-Identifier: LGPL-2.1-only", "lgpl"),
    ("BSD-3-Clause", "bsd"),
    ("Licensed under CC BY-NC-ND 4.0", "cc-by,cc-by-nc-nd"),
    ("licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    ("The license of the public, and the terms of this software and the copy of it.", ""),
    ("He was granted a permission to copy the notice, free of charge, in the public square.", ""),
    ("Software was distributed to any person who asked, without warranty or fee.", ""),
    ("", ""),
    (None, ""),
]


def scan(spark, texts):
    return [r.labels for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_notes(spark):
    assert scan(spark, [t for t, _ in NOTES]) == [label for _, label in NOTES]


def test_changed_notices(spark):
    """Every notice alone, within other words, with a word put in, and with a word in twelve changed; half of one is none."""
    rng = random.Random(4)
    texts, want = [], []
    for label, notice in license.NOTICES:
        words = notice.replace("[", "").replace("]", "").split()
        free = [i for i in range(3, len(words) - 3) if all(w not in notice[notice.find("[") : notice.find("]")].split() for w in words[i - 2 : i + 3])]
        at = rng.choice(free)
        changed = list(words)
        changed[at] = "zzz"
        base = {b for phrase, b in license.BASE.items() if phrase in " ".join(words)}
        named = ",".join(sorted({label} | base))
        forms = [words, ["some", "other", "text", *words, "and", "more"], [*words[:at], "qq", *words[at:]], changed]
        texts += [" ".join(f).capitalize() + "." for f in forms]
        want += [named] * len(forms)
    got = scan(spark, texts)
    assert got == want
    halves = [" ".join(rng.sample(n.replace("[", "").replace("]", "").split(), len(n.split()) // 2)) for _, n in license.NOTICES]
    assert set(scan(spark, halves)) <= {"", "gpl"}


def test_templates_are_told_apart():
    texts = [t for _, t in license.method_templates()]
    assert len(texts) == len(set(texts)) and len({label for label, _ in license.method_templates()}) >= 17
