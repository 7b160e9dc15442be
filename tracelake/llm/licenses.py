"""License scans, in DataFrame functions only: MinHash bands retrieve templates for text windows, containment verifies.

Words are runs of letters and digits of the lower-cased text.  For each length of a template the text is cut into
overlapping windows, a little longer than the template, at a stride of a quarter of its shingles, so each place where
a template may stand lies whole in one window.  A window that holds at least CONTAINED of a template's shingles has a
Jaccard similarity of at least 1/3 to it; with BANDS bands of one row a template is missed with a probability under
(2/3) ** BANDS, and one that stands word for word (similarity over 2/3 for all but the shortest) almost never.  Then the share of the template's five-word
shingles that the window holds is counted exactly.

Windows without any anchor word are passed over: anchors are chosen so that more than a quarter of the shingles of each
template have one, so a window without anchors cannot hold CONTAINED of them.

Defined results: null, empty or short texts match nothing; a template that occurs more than once in a text gives one
row, with the best containment and the first place; repeated rows count as one document; a null id is kept as null; a very
long text is cut into pieces of PIECE words, each with what its windows reach beyond it; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

CONTAINED = 0.75
BANDS = 24
WORDS = 5
WORD = r"[\p{L}\p{N}]+"
#: Words of a text whose windows are made from one row.
PIECE = 256
#: Templates are compared in memory; their number is bounded.
MOST_TEMPLATES, MOST_CHARS = 2000, 4_000_000

# Fixed values: (license, text) of common notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("MIT-name", "Licensed under the MIT License."),
    ("MIT-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("AGPL", "under the terms of the GNU Affero General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-name", "Licensed under the BSD 3-Clause License."),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(templates: list[tuple[str, str]]) -> list[str]:
    """Words such that more than 1 - CONTAINED of each template's shingles hold one; the most telling words first."""
    chosen: set[str] = set()
    for _, text in templates:
        w = template_words(text)
        grams = [w[i : i + WORDS] for i in range(max(1, len(w) - WORDS + 1))]
        for word in sorted(set(w), key=lambda x: (-sum(x in g for g in grams) * (len(x) > 3), -len(x), x)):
            if sum(any(x in chosen for x in g) for g in grams) > (1 - CONTAINED) * len(grams):
                break
            chosen.add(word)
    return sorted(chosen)


def shingles(words: Column) -> Column:
    n = F.size(words) - (WORDS - 1)
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i, WORDS), " "))


def minima(hashes: Column) -> Column:
    def band(b: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(b), h)))

    return F.array(*[band(b) for b in range(BANDS)])


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): each license whose template a window of the text holds."""
    if len(templates) > MOST_TEMPLATES or sum(len(t) for _, t in templates) > MOST_CHARS:
        raise ValueError(f"more than {MOST_TEMPLATES} templates or {MOST_CHARS} characters of them")
    spark = docs.sparkSession
    rows = [(name, w, len(w)) for name, t in templates if (w := template_words(t))]
    if short := [name for name, w, n in rows if n < WORDS] or len(rows) < len(templates):
        raise ValueError(f"templates of fewer than {WORDS} words can't be matched: {short}")
    known = spark.createDataFrame(rows, "license string, words array<string>, length int")
    known = known.withColumn("wanted", F.array_distinct(shingles(F.col("words")))).drop("words")
    wanted = known.select(F.monotonically_increasing_id().alias("template"), "license", "wanted", "length")
    wanted = spark.createDataFrame(wanted.collect(), wanted.schema)  # as many rows as templates
    known = wanted.select("template", "length", F.posexplode(minima(F.transform("wanted", lambda s: F.xxhash64(s)))).alias("band", "least"))
    stop = anchors(templates)
    lowered = docs.select(F.col(id).alias("doc_id"), F.lower(F.col(text)).alias("low")).where(F.col("low").rlike("|".join(stop)))
    lengths = sorted({n for _, _, n in rows})
    step_of = {n: max(1, (n - WORDS + 1) // 4) for n in lengths}
    longest = max(n + step for n, step in step_of.items())
    # a window belongs to the piece in which it starts, so a long text costs its length, not that times its windows
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PIECE).cast("int")), lambda k: F.struct((k * PIECE).alias("base"), F.slice("w", k * PIECE + 1, F.lit(PIECE + longest)).alias("w")))
    words = lowered.select("doc_id", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    words = words.select("doc_id", F.explode(pieces).alias("piece")).select("doc_id", "piece.base", "piece.w")
    words = words.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(x.isin(*stop), F.col("base") + i)), lambda i: i.isNotNull())).where("size(at) > 0")

    def starts(length: int) -> Column:
        """Starts of the windows of a length that hold an anchor."""
        step = step_of[length]
        size = length + step
        near = F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / step).cast("int")), F.floor(p / step).cast("int"))))
        mine = F.filter(F.array_distinct(near), lambda k: (k * step >= F.col("base")) & (k * step < F.col("base") + PIECE))
        return F.transform(mine, lambda k: F.struct((k * step).alias("start"), F.lit(size).alias("size"), F.lit(length).alias("length")))

    windows = words.select("doc_id", "base", "w", F.explode(F.concat(*[starts(n) for n in lengths])).alias("x")).select(
        "doc_id", F.col("x.start").alias("start"), F.col("x.length").alias("length"), shingles(F.slice(F.col("w"), F.col("x.start") - F.col("base") + 1, F.col("x.size"))).alias("grams"))
    banded = windows.where("size(grams) > 0").select("*", F.posexplode(minima(F.transform("grams", lambda s: F.xxhash64(s)))).alias("band", "least"))
    # of each template 24 short rows are sent for its bands, its shingles once; MOST_CHARS bounds both
    found = banded.join(F.broadcast(known), ["length", "band", "least"]).join(F.broadcast(wanted.drop("length")), "template")
    held = (F.size(F.array_intersect("wanted", "grams")) / F.size("wanted")).alias("containment")
    sure = found.select("doc_id", "license", "start", held).where(F.col("containment") >= CONTAINED)
    return sure.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("first_word"), F.countDistinct("start").alias("n_windows"))
