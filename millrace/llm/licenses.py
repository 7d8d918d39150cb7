"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Units are a text's lines and, where lines follow each other without a blank one, their paragraphs.  A
unit's words are its runs of letters, digits and dots in lower case.  It is compared to a template as a whole
and by windows of the template's size, one from each of its bigrams that the template holds, so that a
notice counts that stands between other words.  Bounds on sizes prune both: with a and b bigrams the
coefficient is at most 2 min(a, b) / (a + b), so a template of m bigrams shares at least
threshold * m / (2 - threshold) of them with any text that reaches the threshold, and a unit that holds
fewer is not compared.  Column expressions only; a document is scanned within its row, without any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.7
#: Notices as they are commonly worded.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![a-z0-9])"), lambda w: w != "")


def _bigrams(w: Column) -> Column:
    """Hashes of neighbouring words in their order; empty for fewer than two."""
    n = F.size(w)
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _with(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def templates(spark: SparkSession, named=None) -> list[tuple[str, list[int]]]:
    """(licence, bigram hashes) of each template: a few hundred values, computed once by the same expressions."""
    flat = [(name, t) for name, ts in (named or TEMPLATES).items() for t in ts]
    df = spark.createDataFrame(flat, "name string, t string").select("name", F.array_distinct(_bigrams(words(F.col("t")))).alias("g"))
    return sorted((r.name, list(r.g)) for r in df.collect())


def best_match(unit: Column, known: list[tuple[str, list[int]]], threshold: float = THRESHOLD) -> Column:
    """struct(score, license) of the most similar template, null below the threshold; ties to the later name."""
    # a coefficient of the threshold needs so many shared bigrams, and no fewer in the unit
    least = {len(t): math.ceil(threshold * len(t) / (2 - threshold) - 1e-9) for _, t in known}
    low, every = min(least.values()), sorted({g for _, t in known for g in t})

    def likeness(g: Column, t: list[int]) -> Column:
        return _with(F.array_distinct(g), lambda d: F.lit(2.0) * F.size(F.array_intersect(d, F.lit(t))) / (F.size(d) + len(t)))

    def compare(g: Column, at: Column, name: str, t: list[int]) -> Column:
        """`at`: the places (from 1) of the bigrams of g that any template holds."""

        def scored(own: Column) -> Column:
            windows = F.transform(own, lambda i: likeness(F.slice(g, i, F.lit(len(t))), t))
            score = F.greatest(likeness(g, t), F.array_max(windows))
            enough = F.size(F.array_distinct(F.transform(own, lambda i: F.element_at(g, i)))) >= least[len(t)]
            found = _with(score, lambda x: F.when(x >= threshold, F.struct(x.alias("score"), F.lit(name).alias("license"))))
            return F.when(F.size(own) >= least[len(t)], F.when(enough, found))

        return _with(F.filter(at, lambda i: F.element_at(g, i).isin(t)), scored)

    def best(g: Column) -> Column:
        places = F.filter(F.transform(g, lambda x, i: F.when(x.isin(every), i + 1)), lambda i: i.isNotNull())

        def of_any(at: Column) -> Column:
            found = [compare(g, at, name, t) for name, t in known]
            return F.when(F.size(at) >= low, F.greatest(*found) if len(found) > 1 else found[0])

        return _with(places, of_any)

    # `low` bigrams have low + 1 words and low blanks between them
    fits = F.length(unit) >= 2 * low
    return F.when(fits, _with(words(unit), lambda w: F.when(F.size(w) - 1 >= low, _with(_bigrams(w), best))))


def scan(docs: DataFrame, threshold: float = THRESHOLD, named=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_units, n_matches, license, score, matches for every row of `docs`.

    matches: struct(unit, score, license) per matching unit, lines numbered from 0, then paragraphs; license
    and score are the best of them (highest score, then the later name), null without a match; a notice on
    one line of a paragraph counts for the line and for the paragraph.  A null text
    counts as empty; repeated rows and null ids are kept as they are; further columns are ignored.
    """
    known = templates(docs.sparkSession, named)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[\x20\x09\x0D]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = docs.select(F.col(id_col).cast("long").alias(id_col), F.concat(lines, paragraphs).alias("units"))
    hit = F.transform("units", lambda u, i: _with(best_match(u, known, threshold), lambda m: F.when(m.isNotNull(), F.struct(i.alias("unit"), m.score.alias("score"), m.license.alias("license")))))
    out = units.select(id_col, F.size("units").cast("long").alias("n_units"), F.filter(hit, lambda h: h.isNotNull()).alias("matches"))
    best = F.array_max(F.transform("matches", lambda h: F.struct(h.score, h.license)))
    return out.select(id_col, "n_units", F.size("matches").cast("long").alias("n_matches"), best.license.alias("license"), best.score.alias("score"), "matches")
