"""License scans with DataFrame functions only: MinHash bands over windows, then exact containment.

A text is lower-cased and read as runs of a-z and 0-9; its 5-word shingles are hashed.
For templates of m shingles, windows of twice the class's length start at every
class's length, so each run of a template's length lies whole in some window. A window's
MinHash signature has BANDS bands of one row each: a window that holds c of the
template's shingles has a Jaccard similarity of at least cm / (2m' + (1 - c)m) with it,
m' < 2m being the class's length, and is missed with a probability of (1 - J)**BANDS:
at c = 0.8 under 1e-3, as J is 0.19 at least. Windows whose bands collide with a template's are verified: the
share of the template's distinct shingles found in the window must be 0.8 or more.

Only windows are hashed that hold one of a few rare words: they are chosen so that less
than 0.8 of each template's shingles have none of them, so a match always holds one.
Documents without such a word are passed over. The template table is a fixed
list in this module, so it may be broadcast.

Defined results: null, blank and short texts match nothing; texts are read whole; a
document gets one row per template, that of its best window (the first of equals);
repeated rows count as one document's windows; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 5, 33, 0.8

#: Opening words of widely used license notices (fixed values, public texts).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


#: Words too common to tell a notice by (fixed values).
COMMON = frozenset("a an and any are as at be by can for from in is it its may not of on or that the this to under use with without you".split())


def normal_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    """Distinct shingles of a template, in order."""
    w = normal_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def needed_words(templates) -> list[str]:
    """Words of which every match holds one: rare ones, few per template.

    A match holds at least CONTAINMENT of a template's shingles, so words that are in all
    but fewer than that share of them will do.
    """
    out: list[str] = []
    for _, t in templates:
        every = template_shingles(t)
        left = list(every)
        while left and len(left) >= CONTAINMENT * len(every):
            words = sorted({w for s in left for w in s.split()})
            known = [w for w in words if w in out]
            best = known[0] if known else max(words, key=lambda w: (w not in COMMON and not w.isdigit(), min(len(w), 7), sum(w in s.split() for s in left)))
            if best not in out:
                out.append(best)
            left = [s for s in left if best not in s.split()]
    return out


def class_length(m: int) -> int:
    """The least power of two that is m or more."""
    return 1 << (m - 1).bit_length()


def normal(text: Column) -> Column:
    """Runs of a-z and 0-9 of a lower-case text, one space apart."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def shingles(words: Column) -> Column:
    """Hashes of the shingles of an array of at least SHINGLE words."""
    at = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def signature(hashes: Column) -> Column:
    """Least hash of the array under each of BANDS hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, k))))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """license, length (of its class), hashes, signature: as many rows as templates."""
    rows = [(name, class_length(len(s)), s) for name, t in templates if (s := template_shingles(t))]
    table = spark.createDataFrame(rows, "license string, length int, texts array<string>")
    hashed = table.select("license", "length", F.transform("texts", lambda s: F.xxhash64(s)).alias("hashes"))
    return hashed.withColumn("signature", signature(F.col("hashes")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word (of the window), n_windows (windows verified), for matches only."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    lengths = sorted({class_length(len(template_shingles(t))) for _, t in templates})
    needed = needed_words(templates)
    # explode(array(x)) keeps x: the optimizer would else put its expression wherever it is read, also into lambdas
    low = docs.select(F.col(key).alias("doc_id"), F.explode(F.array(F.lower(F.col(text)))).alias("low"))
    asked = functools.reduce(lambda a, b: a | b, [F.col("low").contains(w) for w in needed])
    words = low.filter(asked).select("doc_id", F.explode(F.array(F.split(normal(F.col("low")), " "))).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(needed), i)), lambda i: i.isNotNull())
    words = words.filter(F.size("words") >= SHINGLE).select("doc_id", "words", F.explode(F.array(at)).alias("at")).filter(F.size("at") > 0)

    # windows of each class's length that hold a needed word; the others hold no shingle of a template
    length = F.col("length")
    classed = words.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    first = lambda p: F.greatest(F.ceil((p - 2 * length - (SHINGLE - 2)) / length), F.lit(0))
    steps = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(first(p).cast("int"), F.floor(p / length).cast("int")))))
    last = F.greatest(F.size("words") - (SHINGLE - 1) - length, F.lit(1))
    starts = F.filter(F.transform(steps, lambda k: k * length), lambda s: s < last)
    placed = classed.select("doc_id", "words", "length", F.explode(starts).alias("start"))
    part = F.slice("words", F.col("start") + 1, 2 * length + (SHINGLE - 1))
    cut = placed.select("doc_id", "length", "start", F.explode(F.array(part)).alias("part")).filter(F.size("part") >= SHINGLE)
    rows = cut.select("doc_id", "length", "start", F.explode(F.array(shingles(F.col("part")))).alias("w")).select("*", signature(F.col("w")).alias("bands"))
    opened = rows.select("doc_id", "length", "start", "w", F.posexplode("bands").alias("band", "value"))
    bands = table.select("license", "length", "hashes", F.posexplode("signature").alias("band", "value"))
    hits = opened.join(F.broadcast(bands), ["length", "band", "value"])
    share = F.size(F.array_intersect("w", "hashes")) / F.size("hashes")
    found = hits.select("doc_id", "license", "start", share.alias("containment")).filter(F.col("containment") >= CONTAINMENT)
    once = found.groupBy("doc_id", "license", "start").agg(F.max("containment").alias("containment"))
    best = F.max(F.struct("containment", (-F.col("start")).alias("s"))).alias("m")
    return once.groupBy("doc_id", "license").agg(best, F.count("*").alias("n_windows")).select(
        "doc_id", "license", F.col("m.containment").alias("containment"), (-F.col("m.s")).alias("first_word"), "n_windows"
    )
