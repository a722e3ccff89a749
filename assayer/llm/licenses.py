"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are words (A-Z lowered, runs of letters a-z and digits) in shingles of five.  For a template of
``t`` distinct shingles a text is cut into windows of ``2t`` shingles, a new one every ``t + 1``, so every stretch of
``t`` shingles lies whole in one window.  A window that holds three quarters of a template has a similarity of at
least 1/3 to it; with 32 bands of one MinHash each it meets the template in some band with a probability above
0.99999.  Windows without any template shingle have similarity 0 and are not signed.  A met template counts when the
window holds at least 75 of 100 of its shingles, compared exactly.

Column expressions only; the template tables are a few hundred rows.  Null text counts as empty.  A template with fewer
than five words is one shingle of all its words and matches texts of just these words.  Rows with the same
``doc_id`` are one document; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, id_and_text
from assayer.session import stored

WORDS, BANDS = 5, 32
SHARE, OF = 75, 100

# Short forms of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))))


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle_texts(found: Column) -> Column:
    """Shingles by place; an array slice would copy the whole array for each of them."""
    n = F.size(found)
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), n - WORDS))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(places, lambda i: F.concat_ws(" ", *[F.get(found, i + k) for k in range(WORDS)]))
    )


def minhashes(found: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda s: F.array_min(F.transform(found, lambda x: F.xxhash64(x, s))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, license, containment`` for every license that a document holds; containment is its best window's."""
    spark = docs.sparkSession
    listed = [(name, template_shingles(text)) for name, text in templates.items() if template_words(text)]
    table = spark.createDataFrame(listed, "license string, texts array<string>").select(
        "license", F.transform("texts", lambda s: F.xxhash64(s)).alias("template"), F.size("texts").alias("t")
    )
    known = F.array(*[F.xxhash64(F.lit(s)) for s in sorted({s for _, texts in listed for s in texts})])
    found = id_and_text(docs).filter("doc_id IS NOT NULL").select("doc_id", words(F.col("text")).alias("words"))
    found = found.select("doc_id", F.transform(shingle_texts(F.col("words")), lambda s: F.xxhash64(s)).alias("shingles"))
    sizes = sorted({len(texts) for _, texts in listed})
    starts = lambda t: F.sequence(F.lit(1), F.size("shingles"), F.lit(t + 1))

    def windows_of(t: int) -> Column:
        def window(i: Column) -> Column:
            last = F.least(i + (2 * t - 1), F.size("shingles"))
            held = F.transform(F.sequence(i, last), lambda j: F.element_at("shingles", j))
            return F.struct(F.lit(t).alias("t"), i.alias("at"), F.array_distinct(held).alias("window"))

        return F.transform(starts(t), window)

    cut = F.concat(*[windows_of(t) for t in sizes])
    # stored as null, not filtered: a filter would be moved below the splitting and repeat it for each word
    found = stored(found.select("doc_id", F.when(F.arrays_overlap("shingles", known), F.col("shingles")).alias("shingles")), "license-texts")
    held = F.filter(cut, lambda w: F.arrays_overlap(w["window"], known))
    windows = found.filter("shingles IS NOT NULL").select("doc_id", F.explode(held).alias("w")).select("doc_id", "w.*")
    windows = stored(windows, "license-windows")
    signed = windows.select("doc_id", "t", "at", "window", F.posexplode(minhashes(F.col("window"))).alias("band", "least"))
    wanted = table.select("license", "template", "t", F.posexplode(minhashes(F.col("template"))).alias("band", "least"))
    met = signed.join(F.broadcast(wanted), ["t", "band", "least"])
    share = F.size(F.array_intersect("template", "window"))
    exact = met.select("doc_id", "license", "t", share.alias("shared")).filter(F.col("shared") * OF >= F.col("t") * SHARE)
    return exact.groupBy("doc_id", "license").agg(F.max(F.col("shared") / F.col("t")).alias("containment"))
