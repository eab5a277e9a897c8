"""License scans by MinHash over text windows (operator 2; DataFrame
functions only).

Texts and license templates become shingles of ``SHINGLE`` words.  A
template's distinct shingles are cut into parts of at most ``LONGEST``; parts
are classed by their size, class k holding 2**k to 2**(k+1)-1 shingles.  For
each class a text is read in windows of 2**(k+2) shingles, one every 2**(k+1),
so that a whole part always lies inside some window and makes up at least a
quarter of it.  A window's MinHash has ``BANDS`` bands of one row; a part is
retrieved for a window when any band agrees.  At a Jaccard index of 1/4 (the
whole part in the window) a band agrees in one of 32 with probability 0.9999,
at 0.19 (four fifths of it) with 0.999.  Retrieved parts are then verified
exactly, once per window: the share of the template's shingles that the best
windows of its parts contain must be at least ``CONTAINMENT``.

A band can only lead to a template when its minimum is one of the shingles of
its class's parts, so windows are sets of these alone: leaving the others out
never lowers an index.  They are found by joining the texts' shingles with the
templates' (a row each); only those that meet move on, grouped by window.  The
template tables are counted and broadcast up to ``BROADCAST_ROWS`` rows;
beyond, the same joins shuffle.  The list has no limit of its own.

Cases: null text is empty; a text or template of fewer than ``SHINGLE`` words
has no shingle and no match; repeated ids share their matches; null ids are
kept; an empty table or template list gives rows without matches; equal
templates each match; null templates are empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .common import text_of

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
LONGEST = 63                   # shingles of a template part
BROADCAST_ROWS = 1_000_000     # of a narrow template table: tens of MB
SEED = 71
_WORD = r"[\p{L}\p{N}]+"

# FIXED VALUES: statements, notices and texts of public licenses.  Further
# ones come from files (read_templates).
_NO_WARRANTY = """
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
    USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
    of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
    with the distribution. """ + _NO_WARRANTY
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the "
                   "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                "the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", _BSD_2.replace(_NO_WARRANTY, "") + """
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. """ + _NO_WARRANTY),
    ("MIT", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must
        not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. 2. Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
        not be removed or altered from any source distribution."""),
    ("BSL-1.0", """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
        permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright
        notices in the Software and this entire statement, including the above license grant, this restriction and
        the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
        derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor."""),
    ("Unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
        laws, the author or authors of this software dedicate any and all copyright interest in the software to the
        public domain. We make this dedication for the benefit of the public at large and to the detriment of our
        heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law."""),
    ("LGPL-2.1", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version."""),
    ("GPL-2.0", """
        This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version."""),
    ("AGPL-3.0", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version."""),
]


def collision_probability(jaccard: float, bands: int = BANDS) -> float:
    """That two sets of this Jaccard index agree in a band of one row."""
    return 1 - (1 - jaccard) ** bands


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The text's shingles as 64-bit hashes, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(
            F.sequence(F.lit(1), F.size(w) - (size - 1)),
            lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)])))

    # one evaluation of the words for the whole array
    none = F.array().cast("array<bigint>")
    return F.coalesce(F.transform(F.array(words), of)[0], none)


def _seeds(bands: int) -> list[int]:
    """Masks whose leading bits differ, so that the minima of x XOR mask over
    hashed shingles are those of different orders."""
    step = (1 << 64) // bands
    value, out = SEED, []
    for i in range(bands):
        value = (value * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        mask = (i * step + value % step) % (1 << 64)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _bands(shingles: Column, bands: int) -> Column:
    seeds = F.array(*[F.lit(s) for s in _seeds(bands)])
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(s))))


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """``license, body``: a row per text file of the folder, named by it."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("body"))


def template_parts(spark: SparkSession, templates: list[tuple[str, str]] | DataFrame,
                   bands: int = BANDS, longest: int = LONGEST) -> DataFrame:
    """``license, template, part, shingles, whole, kind, keys``: one row per
    part of the given templates (a list, or a table ``license, body``)."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates, "license string, body string")
    # a template is its license and text, however the rows arrive
    hashed = templates.select("license", F.xxhash64("license", "body").alias("template"),
                              F.array_distinct(shingle_hashes(text_of("body"))).alias("all")).distinct()
    whole = F.size("all")
    parts = F.ceil(whole / longest).cast("int")
    return (hashed.where(whole > 0)
            .select("license", "template", "all", whole.alias("whole"), F.ceil(whole / parts).cast("int").alias("width"),
                    F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
            .withColumn("shingles", F.slice("all", F.col("part") * F.col("width") + 1, F.col("width")))
            .where(F.size("shingles") > 0)
            .select("license", "template", "part", "shingles", "whole",
                    F.floor(F.log2(F.size("shingles"))).cast("int").alias("kind"),
                    _bands(F.col("shingles"), bands).alias("keys")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text", bands: int = BANDS, containment: float = CONTAINMENT,
         broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The matches: ``doc_id, license, template, containment, first_word``
    (``template``: a hash of license and text; ``first_word``: where the
    earliest of its parts' best windows begins, 0-based)."""
    spark = docs.sparkSession
    parts = store(template_parts(spark, templates, bands))
    size = parts.agg(F.count("*").alias("parts"), F.sum(F.size("shingles")).alias("shingles")).first()
    narrow = max(size["parts"] * bands, size["shingles"] or 0) <= broadcast_rows
    small = F.broadcast if narrow else (lambda df: df)

    # the template shingles in the texts; a text is known by its id and hash
    wanted = parts.select("kind", F.explode("shingles").alias("shingle")).distinct()
    body = text_of(text_col)
    hits = (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_hash"),
                        F.posexplode(shingle_hashes(body)).alias("pos", "shingle"))
            .join(small(wanted), "shingle"))

    # each lies in the window that begins at or before it and, as windows overlap by half, in the one before
    step = F.expr("shiftleft(2, kind)")
    last = F.col("pos") - F.col("pos") % step
    starts = F.when(last > 0, F.array(last - step, last)).otherwise(F.array(last))
    windows = (hits.select("doc_id", "text_hash", "kind", "shingle", F.explode(starts).alias("at"))
               .groupBy("doc_id", "text_hash", "kind", "at").agg(F.collect_set("shingle").alias("window"))
               .withColumn("window_keys", _bands(F.col("window"), bands)))
    index = parts.select("kind", "template", "part", F.posexplode("keys").alias("band", "key"))
    # of several agreeing bands the first one counts, so a window and a part are verified once
    agree = F.zip_with("window_keys", "keys", lambda x, y: x == y)
    found = (windows.select("*", F.posexplode("window_keys").alias("band", "key"))
             .join(small(index), ["kind", "band", "key"])
             .join(small(parts.drop("kind")), ["template", "part"])
             .where(F.col("band") == F.array_position(agree, True) - 1)
             .select("doc_id", "at", "license", "template", "part", "whole",
                     F.size(F.array_intersect("window", "shingles")).alias("common")))
    # the best window of each part, then the share over the template's parts
    best = (found.groupBy("doc_id", "license", "template", "whole", "part")
            .agg(F.max(F.struct("common", (-F.col("at")).alias("back"))).alias("best")))
    return (best.groupBy("doc_id", "license", "template", "whole")
            .agg(F.sum("best.common").alias("common"), F.min(-F.col("best.back")).alias("first_word"))
            .withColumn("containment", F.col("common") / F.col("whole"))
            .where(F.col("containment") >= containment)
            .select("doc_id", "license", "template", "containment", "first_word"))


def licenses(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_licenses, licenses`` (ascending,
    comma-joined)``, containment`` (the best, null without a match)."""
    found = (scan(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias("found_id"))
             .agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("containment").alias("containment")))
    return (docs.select(F.col(id_col).alias("doc_id"))
            .join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
            .select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
                    F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), "containment"))
