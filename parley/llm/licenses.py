"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts and license templates are hashed to five-word shingles.  Templates are small, so every
window of theirs is indexed; texts are cut into overlapping windows of the same widths (a
power of two of shingles, at most ``MAX_WIDTH``, and so that width and step together are at most
one more than the template has) with a step of half a width, so every copy of a template holds a
whole text window at any offset.  A window's sketch is ``BANDS`` bands of ``ROWS_PER_BAND`` minima; a text window
inside a copied passage equals a template window and collides for certain, and one with
similarity s collides with probability ``1 - (1 - s ** ROWS_PER_BAND) ** BANDS`` (0.97 at 0.8 for one
window; an occurrence has several).  Around every collision the exact containment
``|template & region| / |template|`` of distinct shingles is computed, and ``THRESHOLD`` decides.

Before any of this, a text without an anchor is passed by without loss: anchors are words
of each template such that more than ``1 - THRESHOLD`` of its shingles hold one.

Defined cases: null and empty texts match nothing; texts of fewer than five words have one
shingle of all their words; rows are judged one by one, so repeats get equal results;
an empty table gives no rows, no templates give no matches; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import checked_broadcast, materialise

SHINGLE = 5
THRESHOLD = 0.8
MAX_WIDTH = 8
BANDS = 6
ROWS_PER_BAND = 2
MAX_TEMPLATES = 20_000     # templates are a curated list, which the driver holds
WORDS = r"[\p{L}\p{N}]+"

# --- fixed values: public license notices ---------------------------------------
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    # the version stands far from what tells these three apart
    ("GPL", "under the terms of the GNU General Public License as published by"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
)
# ---------------------------------------------------------------------------------


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Words without any of which less than ``threshold`` of the shingles can be present:
    longest words first, until the shingles that hold one exceed the rest allowed."""
    words = _words(text)
    shingles = {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    chosen: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        free = [s for s in shingles if not set(chosen) & set(s)]
        if len(free) < threshold * len(shingles):
            break
        if any(word in s for s in free):
            chosen.append(word)
    return chosen


def _shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""
    def hashed(words: Column) -> Column:
        return F.when(F.size(words) >= SHINGLE, F.transform(
            F.sequence(F.lit(0), F.size(words) - SHINGLE),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))).when(
                F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))), hashed), F.lit(0))


def _bands(shingles: Column, start: Column, width: int) -> Column:
    """array<struct<width, band, key, start>> of one window."""
    window = F.slice(shingles, start + 1, width)

    def least(seed: int) -> Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(F.lit(seed), h)))

    return F.array(*[F.struct(
        F.lit(width).alias("width"), F.lit(b).alias("band"),
        F.xxhash64(*[least(b * ROWS_PER_BAND + r) for r in range(ROWS_PER_BAND)]).alias("key"), start.alias("start"))
        for b in range(BANDS)])


def _width(n_shingles: int) -> int:
    """The widest of which a text window lies whole in any run of ``n_shingles``, whatever its offset."""
    width = min(MAX_WIDTH, 1 << (n_shingles.bit_length() - 1))
    while width + _step(width) - 1 > n_shingles:
        width //= 2
    return width


def _step(width: int) -> int:
    return max(1, width // 2)


def find_licenses(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_licenses, licenses, containment) of every document; ``licenses`` are the
    matched names, sorted and comma-joined."""
    if len(templates) > MAX_TEMPLATES or any(len(_words(t)) < SHINGLE for _, t in templates):
        raise ValueError(f"templates must have {SHINGLE} words or more, and be at most {MAX_TEMPLATES}")
    wanted = sorted({a for _, t in templates for a in anchors(t, threshold)})
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    suspect = F.lit(False)
    for word in wanted:
        suspect = suspect | low.contains(word)
    rows = materialise(docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                                   F.when(suspect, _shingles(F.col("text"))).alias("shingles")), "license-rows")
    if not templates:
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("n_licenses"), F.lit("").alias("licenses"),
                           F.lit(None).cast("double").alias("containment"))

    listed = [(i, name, len(_words(t)) - SHINGLE + 1, t) for i, (name, t) in enumerate(templates)]
    known = spark.createDataFrame(listed, "template int, license string, n int, text string").withColumn(
        "shingles", _shingles(F.col("text"))).drop("text")
    known = materialise(known, "license-templates")
    widths = sorted({_width(n) for _, _, n, _ in listed})
    index = None
    for w in widths:
        own = [i for i, _, n, _ in listed if _width(n) == w]
        part = known.filter(F.col("template").isin(own)).select(
            "template", "n", F.explode(F.flatten(_windows(F.col("shingles"), F.col("n") - w, 1, w))).alias("b"))
        index = part if index is None else index.unionAll(part)
    index = materialise(index.select("template", "n", "b.width", "b.band", "b.key").distinct(), "license-index")

    # dealt out anew: what is left is few bytes, but sketching it is most of the work
    held = rows.filter(F.size("shingles") > 0).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    sketch = [F.when(F.size("shingles") >= w, F.flatten(_windows(F.col("shingles"), F.size("shingles") - w, _step(w), w)))
              .otherwise(F.array().cast("array<struct<width:int,band:int,key:bigint,start:int>>")) for w in widths]
    windows = held.select("row", F.explode(F.concat(*sketch)).alias("b")).select("row", "b.*")
    # regions of three template lengths around a collision, one per template length of text
    met = (windows.join(checked_broadcast(index), ["width", "band", "key"])
           .select("row", "template", F.floor(F.col("start") / F.col("n")).cast("int").alias("g")).distinct())
    checked = (met.join(held.select("row", F.col("shingles").alias("own")), "row")
               .join(checked_broadcast(known, MAX_TEMPLATES), "template"))
    begin = F.greatest(F.lit(0), (F.col("g") - 1) * F.col("n"))
    region = F.slice("own", begin + 1, (F.col("g") + 2) * F.col("n") - begin)
    part = F.size(F.array_intersect(region, F.col("shingles"))) / F.size(F.array_distinct("shingles"))
    found = (checked.select("row", "license", part.alias("containment")).filter(F.col("containment") >= threshold)
             .groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("containment").alias("containment")))
    return rows.select("doc_id", "row").join(found, "row", "left").select(
        "doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), "containment")


def _windows(shingles: Column, last: Column, step: int, width: int) -> Column:
    """Sketches of the windows that start at 0, step, 2 step ... and at ``last``."""
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    return F.transform(starts, lambda s: _bands(shingles, s, width))
