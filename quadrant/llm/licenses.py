"""License scans (operator 1), DataFrame functions only.

Every text is read in overlapping windows of words.  A window is compared with the license
templates by MinHash: each band holds the smallest of its shingles' hashes under one permutation, and a
template is retrieved if any band agrees.  Window and step follow the template's length so that a
window with three quarters of a template's shingles has a Jaccard similarity of 0.4 or more with
it; with 32 bands of one row it is then retrieved with a probability above 0.9999999.
Retrieved templates are verified by exact containment of their five-word shingles.

A band of a window can only agree with a template's if the window holds the very shingle that is the
template's smallest.  So the scan first looks for these shingles (a bounded set: templates
times bands) and computes the bands of just the windows around them; that loses no window.

Words are lower-cased runs of letters and digits; all else separates them, so the comment marks of wrapped
source lines are no words.  Licenses that share most of their notice are told apart by the license's name
(``NAMES``), which a window must hold.

Defined results: NULL or empty text, and text of fewer than five words, matches nothing; a license found in
several windows gives one row with its best window; repeated rows give repeated results; NULL doc_id
stays NULL; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_WORDS = 5
#: Window starts of a text that are looked at together.
BLOCK_WORDS = 512
#: The templates are a parameter; more of them would need a join.
MOST_TEMPLATES = 2000
BANDS = 32
CONTAINMENT = 0.75

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
               "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                      "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                      "distribute, sublicense, and/or sell copies of the Software",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                   "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                   "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
           "notice and this permission notice appear in all copies.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
                 "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Five words that tell a notice from those of the same family.
NAMES = {"GPL-header": "the GNU General Public License", "LGPL-header": "GNU Lesser General Public License", "AGPL-header": "GNU Affero General Public License"}
#: Marks that always stood between words; by now every character but letters, their marks and digits does.
PUNCTUATION = ".,;:!?()[]\"'"
SEPARATORS = "[^\\p{L}\\p{M}\\p{N}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, even where ``use`` looks at it in a loop."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles(words: Column, one: Callable[[Column], Column], empty: str) -> Column:
    """``one`` of every run of five words."""
    return let(words, lambda w: F.when(F.size(w) >= N_WORDS, F.transform(
        F.sequence(F.lit(1), F.size(w) - N_WORDS + 1), lambda i: one(F.slice(w, i, N_WORDS)))).otherwise(F.array().cast(f"array<{empty}>")))


def shingle_hashes(words: Column) -> Column:
    return shingles(F.transform(words, lambda w: F.xxhash64(w)), lambda run: F.xxhash64(run), "bigint")


def shingle_texts(words: Column) -> Column:
    return shingles(words, lambda run: F.array_join(run, " "), "string")


def permuted(value: Column, band: Column) -> Column:
    return F.xxhash64(value, band)


def template_bands(spark: SparkSession, templates: dict[str, str], bands: int = BANDS, names: dict[str, str] | None = None) -> DataFrame:
    """license, name, shingles, window, step, smallest: one row per template, with the smallest shingle of each band."""
    rows = spark.createDataFrame([(k, v, (names or {}).get(k)) for k, v in sorted(templates.items())], "license string, notice string, name string")
    w = rows.select("license", F.lower("name").alias("name"), words(F.col("notice")).alias("w"))
    s = w.select("license", "name", F.array_distinct(shingle_texts(F.col("w"))).alias("shingles"), F.array_distinct(shingle_hashes(F.col("w"))).alias("s"))
    m = F.size("s")
    step = F.greatest(F.lit(1), F.floor(m / 4)).cast("int")
    s = s.filter(m > 0).select("license", "name", "shingles", "s", step.alias("step"), (m + step - 1 + F.floor(m / 4)).cast("int").alias("window"))
    smallest = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform("s", lambda x: F.struct(permuted(x, b).alias("h"), x.alias("x"))))["x"])
    return s.select("license", "name", "shingles", "window", "step", smallest.alias("smallest"))


def literal(held: list, kind: str) -> Column:
    """A bounded table as one constant: an array of its rows."""
    return F.from_json(F.lit(json.dumps([r.asDict() for r in held])), f"array<struct<{kind}>>")


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word (of the best window), matched (the window's words).

    Texts are read in blocks of ``BLOCK_WORDS`` window starts with as many words more as the longest window takes, so
    what meets the templates has a bounded size however long a text is, and each window belongs to one block.  Inside a
    block the windows around a template's smallest shingles are listed once per (template, start); only they, as slices, leave the row.
    """
    if len(TEMPLATES if templates is None else templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates: they travel as a constant of the plan")
    spark = docs.sparkSession
    held = template_bands(spark, TEMPLATES if templates is None else templates, bands, NAMES if templates is None else None).collect()
    longest = max((r["window"] for r in held), default=1)
    values = sorted({x for r in held for x in r["smallest"]}) or [0]
    table = literal(held, "license string, name string, shingles array<string>, window int, step int, smallest array<bigint>")
    w = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    s = w.select("row", "doc_id", "w", shingle_hashes(F.col("w")).alias("s"))
    found = s.filter(F.exists("s", lambda x: x.isin(values)))
    # From here on only texts with such a shingle, a small part of the rows.
    block = lambda i: F.struct((i * BLOCK_WORDS).alias("first"), F.slice(F.col("s"), i * BLOCK_WORDS + 1, F.lit(BLOCK_WORDS + longest)).alias("s"),
                               F.slice(F.col("w"), i * BLOCK_WORDS + 1, F.lit(BLOCK_WORDS + longest + N_WORDS - 1)).alias("w"))
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / BLOCK_WORDS).cast("int")), block), lambda b: F.exists(b["s"], lambda x: x.isin(values)))
    cut = found.select("row", "doc_id", F.explode(blocks).alias("b")).select("row", "doc_id", "b.first", "b.s", "b.w")
    hits = F.filter(F.transform("s", lambda x, i: F.struct((F.col("first") + i).alias("at"), x.alias("x"))), lambda h: h["x"].isin(values))
    cut = cut.withColumn("hits", hits)

    def starts(t: Column) -> Column:
        """The windows of one template around its hits, in steps from the text's beginning, that start in this block."""
        def around(h: Column) -> Column:
            low = F.greatest(F.ceil((h["at"] - t["window"] + 1) / t["step"]), F.ceil(F.col("first") / t["step"])).cast("int")
            high = F.least(F.floor(h["at"] / t["step"]), F.floor((F.col("first") + BLOCK_WORDS - 1) / t["step"])).cast("int")
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        own = F.filter("hits", lambda h: F.array_contains(t["smallest"], h["x"]))
        return F.array_distinct(F.flatten(F.transform(own, around)))

    def window(t: Column, k: Column) -> Column:
        at = k * t["step"]
        return F.struct(t.alias("t"), at.alias("first_word"), F.slice(F.col("s"), at - F.col("first") + 1, t["window"]).alias("inside"),
                        F.slice(F.col("w"), at - F.col("first") + 1, t["window"] + N_WORDS - 1).alias("words"))

    listed = F.flatten(F.transform(table, lambda t: F.transform(starts(t), lambda k: window(t, k))))
    windows = cut.select("row", "doc_id", F.explode(listed).alias("c")).select("row", "doc_id", "c.first_word", "c.inside", "c.words", "c.t.*")
    agrees = F.exists(F.transform("smallest", lambda x, b: F.struct(x.alias("x"), b.alias("b"))), lambda one: F.array_contains(F.col("inside"), one["x"]) & (
        F.array_min(F.transform("inside", lambda x: permuted(x, one["b"]))) == permuted(one["x"], one["b"])))
    candidates = windows.filter(agrees)
    common = F.array_intersect(shingle_texts(F.col("words")), F.col("shingles"))
    share = let(common, lambda c: F.when(F.col("name").isNull() | F.array_contains(c, F.col("name")), F.size(c) / F.size("shingles")).otherwise(0.0))
    verified = candidates.select("row", "doc_id", "license", "first_word", share.alias("containment"),
                                 F.array_join("words", " ").alias("matched")).filter(F.col("containment") >= containment)
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("less"), "matched"))
    return verified.groupBy("row", "doc_id", "license").agg(best.alias("best")).select(
        "doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.less")).cast("long").alias("first_word"), F.col("best.matched").alias("matched"))
