"""Operator 3: licence notices inside texts, with DataFrame functions only.

Texts and templates are lower-cased and cut into words [a-z0-9.+-]+ (trailing dots dropped); a shingle is a pair of
adjacent words, hashed to 64 bits. Windows of WINDOW shingles overlap by half, so that
any 4 adjacent shingles lie whole in one window.

1. Bands: each window has BANDS MinHash values of one row each (the minimum of its hashes XORed with fixed seeds). A
   window that holds a template stretch of k shingles shares a band with probability
   1 - (1 - k / (2 WINDOW - k))^BANDS or more: for k = 4, the worst case of a short template between two windows, 0.9985;
   a longer template lies in several windows, each with a chance of its own.
   A one-row band can only agree where the window holds one of the templates' own shingles, so windows
   without any are left out before their values are computed; that loses no collision.
2. Retrieval: an equi-join of (band, value) with the bands of the templates' windows, at every offset.
3. Verification: exact containment, the share of the template's shingles found in the stretch of text
   around the window that is as long as the template on either side; CONTAINMENT percent or more match.

Templates are a parameter and may be whole licence texts; a library of more than LITERALS shingles is joined by shuffle. A template of two
words matches by its one shingle.
A null or empty text has no matches; a very long one is read whole. Rows that share a doc_id count as one document, and each gets its
matches; a null doc_id gets none. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mortise.llm.graph import bounded_broadcast
from mortise.session import materialise

WINDOW, STRIDE = 8, 4
BANDS = 16
CONTAINMENT = 80
LITERALS = 20_000

# Notices as their licences prescribe or as they are commonly abbreviated.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved",
}


def _shingles(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"), F.lit(0))
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def _against(seed: Column):  # noqa: ANN202
    return lambda x: x.bitwiseXOR(seed)


def _bands(window: Column) -> Column:
    low = [F.array_min(F.transform(window, _against(F.xxhash64(F.lit(f"band {b}"))))) for b in range(BANDS)]
    return F.array(*(F.xxhash64(F.lit(b), v) for b, v in enumerate(low)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment (percent), near (number of the first word of the first matching window): one row for each template found."""
    spark = docs.sparkSession
    book = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", _shingles(F.col("text")).alias("t"))
    book = materialise(book.select("license", F.array_distinct("t").alias("t"), F.col("t").alias("order")).where("size(t) > 0"), "templates")
    # a library of LITERALS shingles or fewer is a literal set; of a larger one, every window's bands are joined
    known = sorted(r[0] for r in book.select(F.explode("t").alias("h")).distinct().limit(LITERALS + 1).collect())
    offsets = F.sequence(F.lit(0), F.greatest(F.size("order") - WINDOW, F.lit(0)))
    bands = book.select("license", "t", F.explode(F.transform(offsets, lambda i: F.slice("order", i + 1, WINDOW))).alias("w"))
    bands = materialise(bands.select("license", "t", F.explode(_bands(F.col("w"))).alias("band")).distinct(), "bands")

    reach = book.agg(F.max(F.size("order"))).first()[0] or 0
    own = docs.select("doc_id", F.explode(F.array(_shingles(F.col("text")))).alias("h"))
    # the numbers of windows that hold a shingle of some template: window k starts at shingle k * STRIDE
    few = len(known) <= LITERALS
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(known), i) if few else i), lambda i: i.isNotNull()) if known else F.array().cast("array<int>")
    each = F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - WINDOW + 1) / STRIDE)).cast("int"), F.floor(i / STRIDE).cast("int"))))
    rows = own.select("doc_id", "h", F.explode(F.array_distinct(each)).alias("k"))
    start = F.col("k") * STRIDE
    around = F.slice("h", F.greatest(F.lit(1), start + 1 - reach), F.lit(WINDOW + 2 * reach))
    rows = rows.select("doc_id", "k", F.slice("h", start + 1, WINDOW).alias("w"), around.alias("around"))
    rows = rows.select("doc_id", "k", "around", F.explode(F.array_distinct(_bands(F.col("w")))).alias("band"))
    found = rows.join(bounded_broadcast(bands, LITERALS * BANDS), "band")
    share = F.floor(100 * F.size(F.array_intersect("t", "around")) / F.size("t"))
    found = found.select("doc_id", "license", "k", share.alias("share")).where(F.col("share") >= CONTAINMENT)
    return found.groupBy("doc_id", "license").agg(F.max("share").cast("long").alias("containment"), (F.min("k") * STRIDE).cast("long").alias("near"))


def license_report(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_licenses, licenses (names, sorted, comma-joined)."""
    found = scan(docs, templates).groupBy(F.col("doc_id").alias("_m_id")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    both = docs.select("doc_id").join(found, F.col("doc_id") == F.col("_m_id"), "left")
    names = F.coalesce("licenses", F.lit(""))
    return both.select("doc_id", F.when(names == "", 0).otherwise(F.size(F.split(names, ","))).cast("long").alias("n_licenses"), names.alias("licenses"))
