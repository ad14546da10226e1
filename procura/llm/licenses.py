"""License scan: MinHash bands over overlapping text windows, then exact containment."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import once

SHINGLE_WORDS = 5
WINDOWS = (1, 4)     # shingles in a window: for notices of up to 3 shingles, and for longer ones
BANDS = 4            # bands of one MinHash each
CONTAINMENT = 0.8
MAX_KEYS = 50_000    # band keys of all notices together
TERM = r"[\p{L}\p{N}]+"

# The notices looked for, of five words and more. A caller may pass a table of its own (license, text).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Notices of fewer words.
SHORT_NOTICES = (
    ("All-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "MIT License"),
)


def notices(spark: SparkSession, short: bool = False) -> DataFrame:
    """The notices; with ``short`` also those of fewer than five words."""
    return spark.createDataFrame([*NOTICES, *(SHORT_NOTICES if short else ())], "license string, text string")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def shingles(tokens: Column, k: int | Column = SHINGLE_WORDS) -> Column:
    """Every run of k tokens joined by blanks, in order; fewer tokens give none."""
    return F.when(F.size(tokens) >= k, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(tokens, i, k)))) \
        .otherwise(F.array().cast("array<string>"))


def _hashes(tokens: Column, k: int = SHINGLE_WORDS) -> Column:
    """XXH64 of every run of k tokens, without building the strings."""
    return F.when(F.size(tokens) >= k, F.transform(
        F.sequence(F.lit(0), F.size(tokens) - k),
        lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]))) \
        .otherwise(F.array().cast("array<bigint>"))


def _band(hashes: Column, band: int, window: int) -> Column:
    """The band's MinHash of every window of ``window`` consecutive shingles: the lowest of
    the hashes under the band's bit permutation (rotation, then a fixed xor)."""
    turn = (band * 64) // BANDS
    def mixed(h: Column) -> Column:
        return h if not turn else F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn))

    if window == 1:
        return F.transform(hashes, mixed)
    return F.when(F.size(hashes) >= window, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - window),
        lambda i: F.least(*[mixed(F.get(hashes, i + j)) for j in range(window)]))).otherwise(F.array().cast("array<bigint>"))


def _window_keys(hashes: Column, bands: int) -> Column:
    """Array of (band number, array of keys). Windows of one shingle need one band: their MinHash is the shingle."""
    parts = [F.struct(F.lit(0).alias("band"), F.array_distinct(_band(hashes, 0, WINDOWS[0])).alias("keys"))]
    parts += [F.struct(F.lit(b + 1).alias("band"), F.array_distinct(_band(hashes, b, WINDOWS[1])).alias("keys"))
              for b in range(bands)]
    return F.array(*parts)


def guard_words(templates: list[list[str]], containment: float) -> list[str]:
    """Strings one of which any lower-cased text that holds enough of a template
    must contain.

    Words are taken until the shingles with one of them outnumber those a text
    may lack; a text without all of these words lacks too many. So testing for
    them first loses nothing, and spares most texts the hashing. Words that
    serve many templates are tried first."""
    words = {w for tokens in templates for w in tokens}
    serves = {w: sum(any(w in x for x in tokens) for tokens in templates) for w in words if len(w) >= 6}
    ranked = sorted(serves, key=lambda w: (-serves[w], -len(w), w)) + sorted(words - set(serves), key=lambda w: (-len(w), w))
    chosen: list[str] = []
    for tokens in templates:
        k = min(SHINGLE_WORDS, len(tokens))
        runs = {tuple(tokens[i:i + k]) for i in range(len(tokens) - k + 1)}
        lacking = len(runs) - math.ceil(len(runs) * containment - 1e-9)

        def held(runs=runs) -> int:
            return sum(any(g in w for g in chosen for w in run) for run in runs)

        for word in ranked:
            if held() > lacking:
                break
            if any(word in w for run in runs for w in run):
                chosen.append(word)
    return sorted(set(chosen))


def _shingle_words(tokens: Column) -> Column:
    """Words in a notice's shingles: five, or all words of a shorter notice."""
    return F.least(F.lit(SHINGLE_WORDS), F.size(tokens))


def _short_keys(tokens: Column) -> Column:
    """Array of (minus the number of words, array of one key) for a notice of fewer than five words."""
    return F.array(*[F.struct(F.lit(-n).alias("band"), F.when(F.size(tokens) == n, _hashes(tokens, n))
                              .otherwise(F.array().cast("array<bigint>")).alias("keys")) for n in range(1, SHINGLE_WORDS)])


def _tagged(band: int):
    return lambda key: F.struct(F.lit(band).alias("band"), key.alias("key"))


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    """That two windows of a Jaccard similarity share a key: 1 - (1 - s)^bands; 1.0 for equal windows."""
    return 1.0 - (1.0 - similarity) ** bands


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """(id, license, template, n_shingles, n_found, containment, first_term): the
    notices that a text holds: at least ``containment`` of a notice's distinct
    five-word shingles occur in it. A notice of fewer words is one shingle. ``template`` is the notice's text,
    ``first_term`` the position (from 0) of the first term of the first shingle found.

    Both sides are cut into windows at every offset: of one shingle for
    notices of up to three, whose containment needs every shingle, else of
    four. Equal windows share all their band keys, so a notice with four
    shingles intact in a row is retrieved with certainty, and windows of
    similarity s with probability 1 - (1 - s)^bands. A notice altered by a few
    words keeps such a run: one changed word breaks five shingles in a row.
    Candidates are then verified exactly on the shingles themselves. Only
    texts with one of the notices' guard words (see :func:`guard_words`) are
    cut into windows; no other text can hold enough of a notice.

    Cases: NULL and empty texts hold no shingle and give no row, as do
    templates without words. Rows repeated with the same id give
    their rows each. Empty tables give no rows. Other columns are not read."""
    wanted = templates.select("license", F.col("text").alias("template"), terms(F.col("text")).alias("t")) \
        .distinct().filter(F.size("t") > 0) \
        .withColumn("shingles", F.array_distinct(shingles(F.col("t"), _shingle_words(F.col("t"))))) \
        .withColumn("h", _hashes(F.col("t"))) \
        .withColumn("keys", F.concat(_window_keys(F.col("h"), bands), _short_keys(F.col("t"))))
    index = wanted.select("license", "template", "shingles", F.explode("keys").alias("b")) \
        .filter((F.col("b.band") < 0) | ((F.col("b.band") == 0) == (F.size("shingles") < WINDOWS[1]))) \
        .select("license", "template", "shingles", F.col("b.band").alias("band"), F.explode("b.keys").alias("key"))
    # The notices are the scan's configuration, of bounded size: their keys become literals.
    entries = index.select("band", "key", "license", "template").limit(MAX_KEYS + 1).collect()
    if len(entries) > MAX_KEYS:
        raise ValueError(f"the notices have more than {MAX_KEYS} band keys; scan them in several tables")
    by_band: dict[int, set[int]] = {}
    for row in entries:
        by_band.setdefault(row["band"], set()).add(row["key"])

    guards = guard_words([r["t"] for r in wanted.select("t").collect()], containment)
    guarded = reduce(lambda a, b: a | b, [F.col("low").contains(g) for g in guards], F.lit(False))
    body = once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), low=F.lower("body")) \
        .filter(guarded).select("id", "body")
    # Named arrays are built once a row; inside a lambda an unnamed one is built for every element.
    body = once(body, t=terms(F.col("body"))).drop("body")
    body = once(body, h=_hashes(F.col("t")))
    hits = [F.array().cast("array<struct<band:int,key:bigint>>")]
    for band, keys in sorted(by_band.items()):
        known = F.array(*[F.lit(k).cast("long") for k in sorted(keys)])
        if band < 0:
            mine = _hashes(F.col("t"), -band)
        else:
            mine = _band(F.col("h"), max(0, band - 1), WINDOWS[0] if band == 0 else WINDOWS[1])
        hits.append(F.transform(F.array_intersect(mine, known), _tagged(band)))
    found = once(body, hit=F.concat(*hits)).filter(F.size("hit") > 0).select("id", "t", "hit")
    table = F.array(*[F.struct(F.lit(r["band"]).alias("band"), F.lit(r["key"]).cast("long").alias("key"),
                               F.lit(r["license"]).alias("license"), F.lit(r["template"]).alias("template"))
                      for r in entries]).cast("array<struct<band:int,key:bigint,license:string,template:string>>")
    retrieved = found.withColumn("candidate", F.explode(F.array_distinct(F.transform(
        F.filter(table, lambda t: F.array_contains(F.col("hit"), F.struct(t["band"].alias("band"), t["key"].alias("key")))),
        lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"))))))
    checked = once(retrieved.select("id", "candidate.license", "candidate.template", "t"), w=terms(F.col("template")))
    checked = once(checked, k=_shingle_words(F.col("w")))
    checked = once(checked, have=shingles(F.col("t"), F.col("k")), want=F.array_distinct(shingles(F.col("w"), F.col("k"))))
    checked = once(checked, n_found=F.size(F.array_intersect("want", "have")), n_shingles=F.size("want")) \
        .withColumn("containment", F.col("n_found") / F.col("n_shingles")) \
        .filter(F.col("n_found") >= F.col("n_shingles") * F.lit(containment) - F.lit(1e-9))
    first = F.array_min(F.filter(F.transform(F.col("want"), lambda s: F.array_position("have", s).cast("int") - 1),
                                 lambda p: p >= 0))
    return checked.select("id", "license", "template", "n_shingles", "n_found", "containment", first.alias("first_term"))
