"""Licence scans, in DataFrame expressions only.

Templates are short notices, as sets of 5-word shingles. Each size class of templates (1, 2, 4, 8 ... shingles)
has overlapping windows a little longer than the class, so that one window holds any occurrence whole. Windows
and templates get BANDS hash minima of one row each; a window with 80 % of a template's shingles has a Jaccard
similarity of LEAST_SIMILARITY or more with it, so some band agrees with a probability over 0.9999. Retrieved
pairs are verified exactly: the share of the template's shingles that the window contains.

Windows that hold none of a few anchor words, chosen so that every shingle of every template has one, share no
shingle with any template and are not signed; texts without anchor words are left at the scan. This loses nothing.

Edge cases: null and empty texts, and those of fewer than five words, match nothing. Very long texts are read
whole. Repeated rows are matched alike, and a (document, licence) pair is returned once. An empty table gives an
empty result. Other columns are ignored. Templates of fewer than five words are refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
LEAST_SIMILARITY = 0.28
BANDS = math.ceil(math.log(1e-4) / math.log(1 - LEAST_SIMILARITY))
TOKEN = r"[\p{L}\p{N}]+"

#: Licence notices in common use.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
}


def template_tokens(notice: str) -> list[str]:
    return [x for x in re.split(r"[^0-9a-z]+", notice.lower()) if x]


def template_shingles(notice: str) -> list[str]:
    t = template_tokens(notice)
    if len(t) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {notice!r}")
    return sorted({" ".join(t[i : i + SHINGLE]) for i in range(len(t) - SHINGLE + 1)})


def anchors(notices: Sequence[str]) -> list[str]:
    """Words of which every shingle of every notice has one: greedily the word in most uncovered shingles, long words first."""
    left = {s for n in notices for s in template_shingles(n)}
    out: list[str] = []
    while left:
        words = sorted({w for s in left for w in s.split()}, key=lambda w: (-(len(w) > 4), -sum(w in s.split() for s in left), w))
        out.append(words[0])
        left = {s for s in left if words[0] not in s.split()}
    return sorted(out)


def size_class(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(n)))


def _minima(shingles: Column) -> Column:
    """The least value of a set of shingles under each band's hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j))))


def _window_begins(size: int) -> Column:
    """The windows of a size class that hold a marked word, as structs of class, first word and number of shingles."""
    stride = max(1, size // 4)
    length = size + stride - 1
    reach = length + SHINGLE - 2  # words of a window, less one
    multiple = lambda i: F.floor(i / stride).cast("int") * stride
    begins = F.flatten(F.transform("marks", lambda i: F.sequence(F.greatest(F.lit(0), multiple(i - reach)), multiple(i), F.lit(stride))))
    return F.transform(F.array_distinct(begins), lambda b: F.struct(F.lit(size).alias("class"), b.alias("begin"), F.lit(length).alias("n")))


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (best), first_word (of the first window that holds it), for each licence of a document."""
    spark = docs.sparkSession
    notices = [(name, n) for name, ns in templates.items() for n in ns]
    listed = spark.createDataFrame([(name, template_shingles(n), size_class(len(template_shingles(n)))) for name, n in notices], "license string, wanted array<string>, class int")
    signed = listed.select("license", "wanted", F.col("class").alias("of_class"), F.posexplode(_minima(F.col("wanted"))).alias("of_band", "of_least"))
    marks = anchors([n for _, n in notices])
    low = F.lower(F.col("text"))
    some = F.lit(False)
    for a in marks:
        some = some | F.contains(low, F.lit(a))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(some)
    tokens = texts.select("doc_id", F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)).alias("tokens"))
    at = F.filter(F.transform("tokens", lambda x, i: F.when(x.isin(marks), i)), lambda i: i.isNotNull())
    found = tokens.withColumn("marks", at).where("size(marks) > 0")
    sizes = sorted({size_class(len(template_shingles(n))) for _, n in notices})
    windows = found.select("doc_id", F.explode(F.concat(*map(_window_begins, sizes))).alias("w"), "tokens").select("doc_id", "w.class", "w.begin", F.slice("tokens", F.col("w.begin") + 1, F.col("w.n") + SHINGLE - 1).alias("words"))
    n = F.size("words")
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice("words", i, SHINGLE), " ")))
    signed_windows = windows.where(n >= SHINGLE).select("doc_id", "class", "begin", shingles.alias("shingles")).select("*", F.posexplode(_minima(F.col("shingles"))).alias("band", "least"))
    # the template table has BANDS rows a notice
    near = signed_windows.join(F.broadcast(signed), (F.col("class") == F.col("of_class")) & (F.col("band") == F.col("of_band")) & (F.col("least") == F.col("of_least")))
    contained = near.withColumn("containment", F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")).where(F.col("containment") >= THRESHOLD)
    return contained.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("begin").alias("first_word"))
