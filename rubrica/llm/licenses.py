"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A text's words (runs of a-z and 0-9, in lower case) give 5-word shingles. Windows of ``WINDOW`` words
overlap by four, so every shingle lies in one window. A window's sketch is one-permutation MinHash: the
shingle hashes fall into 2^``BIN_BITS`` bins, each bin keeps its least hash, and each bin is a band of one
row. Template texts are sketched likewise. A text and a template that share a shingle meet in a band
unless another of the window's at most ``WINDOW - 4`` shingles shares the bin and is smaller, on either
side: at least 1 - 14 / 2^20 for a single shared shingle, and all but certain for several, as a
whole notice has. Retrieved templates are verified exactly: at least ``CONTAINED`` of the template's
distinct shingles, compared as texts, occur in the text.

All of it is DataFrame functions: one narrow pass, no shuffle or join. Templates are constants of this module
and stand in the plan as literals, so their size is fixed.

One row per (document, matched template). Null and empty texts, and texts of fewer than five words,
match nothing. Rows that repeat an id give repeated rows. Several templates may match one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import shared
from .shared import let

WORDS, WINDOW, BIN_BITS, CONTAINED = 5, 12, 20, 0.8

#: Public license notices: (template, license, text).
TEMPLATES = [
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-2", "MIT", "Licensed under the MIT License."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl3-line", "LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl3-line", "AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-line", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-text", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-text", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl3-notice", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9]+"), "")


def _indices(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words_hashes: Column) -> Column:
    return F.transform(_indices(F.size(words_hashes) - (WORDS - 1)), lambda i: F.xxhash64(*(F.get(words_hashes, i + k) for k in range(WORDS))))


def window_sketches(h: Column) -> Column:
    """The bins' least hashes of all windows, in one array. A hash's top bits are its bin, so equal values are equal bins and minima."""
    step = WINDOW - (WORDS - 1)
    windows = F.transform(_indices(F.ceil(F.size(h) / step).cast("int")), lambda i: F.sort_array(F.slice(h, i * step + 1, step)))
    # sorted by bin and hash: the first of each bin is its minimum
    return F.flatten(F.transform(windows, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, 64 - BIN_BITS) != F.shiftrightunsigned(F.get(s, i - 1), 64 - BIN_BITS)))))


def sketch(w: Column) -> Column:
    """Of an array of words."""
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda wh: let(shingle_hashes(wh), window_sketches))


def shingles(w: Column) -> Column:
    return F.transform(_indices(F.size(w) - (WORDS - 1)), lambda i: F.array_join(F.slice(w, i + 1, WORDS), " "))


def template_rows(spark: SparkSession, templates=None) -> list:
    """(template, license, shingles, values): the templates are constants of the module or the caller's own list."""
    rows = spark.createDataFrame([tuple(t) for t in templates or TEMPLATES], "template string, license string, text string")
    return rows.select("template", "license", F.array_distinct(shingles(words(F.col("text")))).alias("shingles"), F.array_distinct(sketch(words(F.col("text")))).alias("values")).collect()


def scan(docs: DataFrame, templates=None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, template, license, n_shared, n_shingles, containment, first_word, best) of every template that a text contains. best: no other that matches from the same word on is contained more."""
    fixed = template_rows(docs.sparkSession, templates)
    every = sorted({v for r in fixed for v in r["values"]})
    known = F.array(*(F.struct(F.lit(r["template"]).alias("template"), F.lit(r["license"]).alias("license"), F.lit(r["shingles"]).cast("array<string>").alias("shingles"), F.lit(r["values"]).cast("array<bigint>").alias("values")) for r in fixed))
    met = lambda w: let(F.filter(sketch(w), lambda v: v.isin(every)), lambda m: F.when(F.size(m) > 0, F.filter(known, lambda t: F.arrays_overlap(t["values"], m))))
    found = lambda w: F.transform(met(w), lambda t: let(
        shingles(w), lambda ws: let(F.array_intersect(t["shingles"], ws), lambda hits: F.struct(
            t["template"].alias("template"), t["license"].alias("license"), F.size(hits).alias("n_shared"), F.size(t["shingles"]).alias("n_shingles"),
            (F.array_position(ws, F.get(hits, F.lit(0))) - 1).alias("first_word")))))
    # explode_outer: no filter on the array is inferred, which would compute it twice
    share = lambda m: m["n_shared"] / m["n_shingles"]
    verified = lambda all_: F.filter(all_, lambda m: share(m) >= contained)
    marked = lambda all_: F.transform(all_, lambda m: m.withField("best", ~F.exists(all_, lambda o: (o["first_word"] == m["first_word"]) & (share(o) > share(m)))))
    rows = docs.select("doc_id", F.explode_outer(let(let(let(words(F.col("text")), found), verified), marked)).alias("m"))
    rows = rows.select("doc_id", "m.*").withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where("template is not null")
    return rows.select("doc_id", "template", "license", "n_shared", "n_shingles", "containment", "first_word", "best")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))
