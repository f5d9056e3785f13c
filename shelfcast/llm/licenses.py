"""License scans: MinHash bands over overlapping windows of a text retrieve license templates, and exact shingle
containment verifies them. DataFrame functions throughout."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import text_digest

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
#: A window that holds a template at the least containment shares a band with it with at least this probability.
CERTAINTY = 0.9999
ROWS = 2
#: Template shingles that one pass over the texts looks for; more are looked for in several passes.
PASS_SHINGLES = 20_000

_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public "
    "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GPL_OLD_NOTICE = (
    "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public "
    "License as published by the Free Software Foundation; {} of the License."
)
_GPL_OLD_LATER = _GPL_OLD_NOTICE.removesuffix(".") + ", or (at your option) any later version."
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_CC_LONG = "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit"

# Notices by which works are licensed, and what in a notice tells it from those of other licenses (phrases
# apart by "|", of which every shingle has to be there).
TEMPLATES = (
    ("AGPL-3.0", _GPL_NOTICE.format("Affero ", "3"), "of the GNU Affero General Public License|either version 3 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "Affero General Public License version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ""),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "the Apache License Version 2.0",
    ),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0.", "under the Apache License 2.0"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "of the Artistic License 2.0"),
    ("BSD-2-Clause", _BSD_START + "THIS SOFTWARE IS PROVIDED BY", "with the distribution this software is provided by"),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "may be used to endorse or promote products",
    ),
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License.", "under the BSD 3-Clause License"),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at",
        "the Boost Software License, Version 1.0",
    ),
    ("CC-BY-4.0", _CC.format("Attribution"), "Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", _CC_LONG.format("Attribution"), "Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ""),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial"), "Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", _CC_LONG.format("Attribution-NonCommercial"), "Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ""),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivatives"), "NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", ""),
    ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike"), "NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ""),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivatives"), "Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ""),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike"), "Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ""),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "related or neighboring rights to this work",
    ),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal.", "under CC0 1.0 Universal"),
    (
        "CDDL-1.0",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the "
        "\"License\"). You may not use this file except in compliance with the License.",
        "the Common Development and Distribution License",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at",
        "the Eclipse Public License 2.0",
    ),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, Version 1.2.", "European Union Public Licence, Version 1.2"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions", "the EUPL, Version 1.2"),
    ("GPL-2.0", _GPL_OLD_NOTICE.format("program", "", "version 2"), "Software Foundation; version 2 of the License|of the GNU General Public License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "General Public License, version 2"),
    ("GPL-2.0-or-later", _GPL_OLD_LATER.format("program", "", "either version 2"), "either version 2 of the License|of the GNU General Public License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3"),
    ("GPL-3.0", _GPL_NOTICE.format("", "3"), "of the GNU General Public License|either version 3 of the License"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "for any purpose with or without fee",
    ),
    ("ISC", "This project is licensed under the ISC License.", "licensed under the ISC License"),
    ("LGPL-2.1", _GPL_OLD_LATER.format("library", "Lesser ", "either version 2.1"), "either version 2.1 of the License|the GNU Lesser General Public License"),
    ("LGPL-3.0", _GPL_NOTICE.format("Lesser ", "3"), "the GNU Lesser General Public License|either version 3 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License.", ""),
    ("MIT", "Licensed under the MIT License.", ""),
    ("MIT", "Distributed under the MIT License.", ""),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "to deal in the Software without restriction",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License, v. 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Open Font License, Version 1.1"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software",
        "unencumbered software released into the public domain",
    ),
    (
        "WTFPL",
        "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To "
        "Public License, Version 2",
        "Want To Public License, Version 2",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        "will the authors be held liable",
    ),
)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows_at(words: Column, size: int) -> Column:
    """Where shingles of ``size`` words begin; a text of fewer words, but not none, has one."""
    n = F.size(words)
    empty = F.array().cast("array<int>")
    return F.when(n == 0, empty).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - size))


def shingle_hashes(words: Column, size: int) -> Column:
    return F.transform(_windows_at(words, size), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size))))


def shingles(words: Column, size: int) -> Column:
    return F.array_distinct(
        F.transform(_windows_at(words, size), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
    )


@dataclass(frozen=True)
class WindowSize:
    """Windows for templates of up to ``largest`` shingles: ``width`` shingles every ``stride``, so that one of them
    holds the whole of any occurrence."""

    largest: int
    stride: int
    width: int

    @staticmethod
    def of(n: int) -> WindowSize:
        largest = 1
        while largest < n:
            largest = max(largest + 1, largest * 5 // 4)
        stride = max(1, largest // 4)
        return WindowSize(largest, stride, largest + stride - 1)

    def similarity(self, n: int, containment: float) -> float:
        """Least Jaccard similarity of a window to a template of ``n`` shingles that it holds so far."""
        return containment * n / (self.width + (1 - containment) * n)


def bands_needed(similarity: float, rows: int, certainty: float) -> int:
    miss = 1 - similarity**rows
    return 1 if miss <= 0 else max(1, math.ceil(math.log(1 - certainty) / math.log(miss)))


def band_keys(hashes: Column, bands: int, rows: int) -> Column:
    """Hashes of the bands of MinHash values, ``rows`` minima to a band."""
    minimum = lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, *(minimum(k * rows + j) for j in range(rows)))
    )


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, template string, telling string")


def _windows_around(hit: Column, w: WindowSize) -> Column:
    """The windows of one size that hold the shingle at ``hit``."""
    low = F.greatest(F.lit(0), F.ceil((hit - (w.width - 1)) / w.stride).cast("int"))
    return F.transform(
        F.sequence(low, F.floor(hit / w.stride).cast("int")),
        lambda k: F.struct(
            F.lit(w.largest).alias("size"), (k * w.stride).alias("first"), F.lit(w.width).alias("width")
        ),
    )


def _windows_to_look_at(known: list[int], sizes: list[WindowSize], size: int) -> Column:
    """Windows of a text's ``words`` and ``hashes`` that hold a known shingle hash; others share no minimum with any
    template. Each part is evaluated once: nothing that lambdas call is computed inside them."""
    marked = F.transform("hashes", lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    hits = F.filter(marked, lambda m: m["h"].isin(known))
    places = F.flatten(F.transform(hits, lambda m: F.concat(*(_windows_around(m["i"], w) for w in sizes))))
    return F.transform(
        F.array_distinct(places),
        lambda x: F.struct(
            x["size"].alias("size"),
            x["first"].alias("first"),
            F.slice("words", x["first"] + 1, x["width"] + (size - 1)).alias("own"),
            F.slice("hashes", x["first"] + 1, x["width"]).alias("own_hashes"),
        ),
    )


def _pass(docs: DataFrame, rows: list, size: int, least: float, certainty: float) -> DataFrame:
    """Matches of some templates: rows (template_no, license_id, hashes, shingles)."""
    spark = docs.sparkSession
    by_size: dict[WindowSize, list] = {}
    for r in rows:
        by_size.setdefault(WindowSize.of(len(r["shingles"])), []).append(r)
    bands = max(
        bands_needed(w.similarity(len(r["shingles"]), least), ROWS, certainty) for w, own in by_size.items() for r in own
    )
    known = sorted({h for r in rows for h in r["hashes"]})
    found = docs.withColumn("words", words_of(F.col("text")))
    found = found.select("doc_id", "digest", "words", shingle_hashes(F.col("words"), size).alias("hashes"))
    # exploded straight away: a filter on the windows would be pushed down and computed within lambdas
    found = found.select("doc_id", "digest", F.explode(_windows_to_look_at(known, list(by_size), size)).alias("w"))
    found = found.select("doc_id", "digest", "w.*")
    found = found.withColumn("band", F.explode(band_keys(F.col("own_hashes"), bands, ROWS)))
    templates = spark.createDataFrame(
        [
            (WindowSize.of(len(r["shingles"])).largest, r["license_id"], r["template_no"], r["hashes"], r["shingles"], r["telling"])
            for r in rows
        ],
        "size int, license_id string, template_no long, t_hashes array<long>, t_shingles array<string>, t_telling array<string>",
    )
    keys = templates.withColumn("band", F.explode(band_keys(F.col("t_hashes"), bands, ROWS))).drop("t_hashes")
    # bounded: at most PASS_SHINGLES shingles a pass (or one template), each in ``bands`` rows
    met = found.join(F.broadcast(keys), ["size", "band"]).dropDuplicates(["doc_id", "digest", "size", "first", "template_no"])
    met = met.withColumn("own_shingles", shingles(F.col("own"), size))
    shared = F.size(F.array_intersect("own_shingles", "t_shingles"))
    told = F.size(F.array_except("t_telling", "own_shingles")) == 0
    return met.select(
        "doc_id", "digest", "license_id", "first", F.size("own").alias("n"), (shared / F.size("t_shingles")).alias("containment"), told.alias("told")
    ).where((F.col("containment") >= least) & F.col("told")).drop("told")


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE_WORDS,
    min_containment: float = MIN_CONTAINMENT,
    certainty: float = CERTAINTY,
    pass_shingles: int = PASS_SHINGLES,
) -> DataFrame:
    """One row per document and license found: ``doc_id``, ``digest`` of the text, ``license_id``, ``containment`` (the
    highest of any window), ``first_word`` and ``last_word`` (of the windows that match, end exclusive), ``n_windows``.

    A template matches where a window of the text holds at least ``min_containment`` of its distinct shingles of
    ``shingle`` words. Windows overlap so that one of them holds any occurrence whole; bands are as many as make a
    window that holds just enough meet its template with probability ``certainty``.

    templates: rows ``license_id``, ``template``; a license may have several. With a column ``telling``, phrases apart
    by "|", a window has to hold every shingle of them too: notices of related licenses share most of their words, and
    differ in their names and versions. Templates and texts without words (null, empty) match nothing; a null license is the empty name; texts of fewer words than a shingle are one
    shingle. Rows with the same id and text count once; a null id is kept. Empty tables give an empty one. More
    than ``pass_shingles`` template shingles are sought in several passes over the texts.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    telling = F.coalesce("telling", F.lit("")) if "telling" in templates.columns else F.lit("")
    phrases = F.filter(F.transform(F.split(telling, r"\|"), words_of), lambda w: F.size(w) > 0)
    listed = templates.select(
        F.coalesce("license_id", F.lit("")).alias("license_id"),
        words_of(F.col("template")).alias("words"),
        F.array_distinct(F.flatten(F.transform(phrases, lambda w: shingles(w, shingle)))).alias("telling"),
    ).where(F.size("words") > 0)
    listed = listed.select(
        "license_id",
        F.array_distinct(shingle_hashes(F.col("words"), shingle)).alias("hashes"),
        shingles(F.col("words"), shingle).alias("shingles"),
        "telling",
    ).distinct()
    base = docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"), F.col(text).alias("text"))
    parts, rows, held = [], [], 0
    for number, row in enumerate(listed.toLocalIterator()):
        if rows and held + len(row["shingles"]) > pass_shingles:
            parts.append(_pass(base, rows, shingle, min_containment, certainty))
            rows, held = [], 0
        rows.append(row.asDict() | {"template_no": number})
        held += len(row["shingles"])
    if rows:
        parts.append(_pass(base, rows, shingle, min_containment, certainty))
    if not parts:
        names = base.select("doc_id", "digest").where("false")
        return names.selectExpr(
            "doc_id", "digest", "'' license_id", "0d containment", "0 first_word", "0 last_word", "0l n_windows"
        )
    met = parts[0]
    for other in parts[1:]:
        met = met.unionByName(other)
    return met.groupBy("doc_id", "digest", "license_id").agg(
        F.max("containment").alias("containment"),
        F.min("first").alias("first_word"),
        F.max(F.col("first") + F.col("n")).alias("last_word"),
        F.count("*").alias("n_windows"),
    )
