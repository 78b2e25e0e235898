"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts and templates are cut into lower-case words of letters and digits, and these into 5-word shingles, with DataFrame
functions only. For a template of n shingles, the windows of 2n shingles begin at every nth, so that each stretch
of n lies whole in one; with containment 0.8 its similarity to the window is at least 0.8 / 2.2. A band is one of
`BANDS` minima; a window retrieves a template if any band agrees, which at that similarity happens with a probability of
1 - (1 - 0.36)^32 > 0.999999. What is retrieved is verified exactly: the share of the template's shingles that the
window has must be `CONTAINED` or more.

A window can agree with a template in a band only if it holds that very shingle, so texts and windows without any of the
shingles that are minima of a template are passed over before signatures are made; this loses nothing. Bands lead to the
names of templates; their shingles are joined by name once a window has retrieved them. Both tables are broadcast, after a
check of their size (`MOST_BYTES` of template texts); larger ones are joined by key, and above `MOST_ANCHORS` minima the
passing over is left out, with the same result.

Templates resemble each other (versions and families of a license, openings and whole texts), so one place of a text may
match several. A match lies from the first to the last of its shingles in the window; where some occur twice, as with notices side by
side, the earlier or the later ones are taken, whichever lie closer together. Matches compete by place: of those that lie on each
other by more than two thirds of the shorter one, one that is no more than half longer than its template counts before others (two
notices side by side may hold all shingles of a third), then the one with most shingles there (so that a whole text goes before its
own opening), then the one with the highest containment, then the tighter match; what has lost to none that counts, counts too, whatever its family. So each notice is its own license, and any
number of different ones in one text all stay. Sets of shingles know no order, though: similar notices with no more than a few words
between them may together hold a third one, which is then reported too, or instead of one that is changed.

Nulls and edge cases: a null text, or one of fewer than five words, has no shingles and no license; templates of fewer
than five words are refused; texts are taken whole; each row is a document of its own, also where ids repeat or are null;
ties for the place go to the first; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS, CONTAINED = 5, 32, 0.8
MOST_BYTES, MOST_ANCHORS = 2 << 20, 20_000

_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_FIRST = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU_HEADER = "{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."

# Texts of well-known licenses, their headers and how they are named, by their usual identifiers.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _GNU_HEADER.format(what="This program", name="GNU Affero General Public License", version="3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause-text": _BSD_FIRST + _BSD_REST,
    "BSD-3-Clause-text": _BSD_FIRST + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_REST,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0-long": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GNU_HEADER.format(what="This program", name="GNU General Public License", version="2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GNU_HEADER.format(what="This program", name="GNU General Public License", version="3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.0-header": _GNU_HEADER.format(what="This library", name="GNU Library General Public License", version="2"),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": _GNU_HEADER.format(what="This library", name="GNU Lesser General Public License", version="2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _GNU_HEADER.format(what="This library", name="GNU Lesser General Public License", version="3"),
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY
    + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(count: Column) -> Column:
    """Where shingles begin among so many words."""
    return F.when(count >= WIDTH, F.sequence(F.lit(1), count - WIDTH + 1)).otherwise(F.array().cast("array<int>"))


def hashes(own: Column) -> Column:
    return F.transform(_places(F.size(own)), lambda i: F.xxhash64(*(F.get(own, i + (k - 1)) for k in range(WIDTH))))


def shingles(own: Column) -> Column:
    return F.transform(_places(F.size(own)), lambda i: F.array_join(F.slice(own, i, WIDTH), " "))


def _seeded(band: int) -> Callable[[Column], Column]:
    return lambda h: F.xxhash64(h, F.lit(band))


def signature(hashed: Column) -> Column:
    return F.array(*(F.array_min(F.transform(hashed, _seeded(k))) for k in range(BANDS)))


def _anchor(hashed: Column, band: int) -> Column:
    """The shingle whose hash is the minimum of a band."""
    return F.array_min(F.transform(hashed, lambda h: F.struct(_seeded(band)(h).alias("low"), h.alias("h"))))["h"]


def _windows(hashed: Column, size: int, anchors: list[int] | None) -> Column:
    """The windows for templates of `size` shingles that hold one of `anchors`, or all windows."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(hashed) - 1), F.lit(size))
    cut = F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), s.alias("start"), F.slice(hashed, s + 1, 2 * size).alias("hashed")))
    return cut if anchors is None else F.filter(cut, lambda w: F.arrays_overlap(w["hashed"], _longs(anchors)))


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<long>")


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, shingles, size, bands, anchors): anchors are the shingles whose hashes are the minima."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string").coalesce(1)
    cut = rows.select("license", F.array_distinct(shingles(words(F.col("text")))).alias("shingles"), F.array_distinct(hashes(words(F.col("text")))).alias("hashed"))
    anchors = F.array(*(_anchor(F.col("hashed"), k) for k in range(BANDS)))
    return cut.select("license", "shingles", F.size("shingles").alias("size"), signature(F.col("hashed")).alias("bands"), F.array_distinct(anchors).alias("anchors"))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment (of the best window) and first_word (of the first match, from 0): a row for each license of each document."""
    known = template_table(docs.sparkSession, templates)
    small = known.select("size", "anchors").collect()
    if any(r["size"] == 0 for r in small):
        raise ValueError("a template has fewer than five words")
    few = sum(len(t.encode()) for t in templates.values()) <= MOST_BYTES
    anchors = {n: sorted({a for r in small if r["size"] == n for a in r["anchors"]}) for n in sorted({r["size"] for r in small})}
    every = sorted({a for held in anchors.values() for a in held})
    passing = len(every) <= MOST_ANCHORS

    own = bound(words(docs[text_col]), lambda w: F.struct(w.alias("words"), hashes(w).alias("hashed")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), own.alias("own"))
    rows = rows.where(F.arrays_overlap("own.hashed", _longs(every)) if passing else F.size("own.hashed") > 0)
    windows = bound(F.col("own.hashed"), lambda hashed: F.concat(*(_windows(hashed, n, held if passing else None) for n, held in anchors.items())))
    cut = rows.select("doc_id", "row", F.col("own.words").alias("words"), F.explode(windows).alias("window"))
    cut = cut.select("doc_id", "row", F.col("window.start").alias("start"), F.col("window.size").alias("size"), F.slice("words", F.col("window.start") + 1, 2 * F.col("window.size") + WIDTH - 1).alias("words"), signature(F.col("window.hashed")).alias("bands"))
    banded = cut.select("doc_id", "row", "start", "size", "words", F.posexplode("bands").alias("band", "low"))
    posted = known.select("license", "size", F.posexplode("bands").alias("band", "low"))
    told = known.select("license", F.col("shingles").alias("template"))
    posted, told = (F.broadcast(posted), F.broadcast(told)) if few else (posted, told)
    # the first agreeing band retrieves a template for a window, the others only repeat it
    met = banded.join(posted, ["size", "band", "low"]).groupBy("doc_id", "row", "start", "license").agg(F.min_by("words", "band").alias("words")).join(told, "license")
    common = F.array_intersect("template", "own")
    tried = met.select("doc_id", "row", "start", "license", "template", shingles(F.col("words")).alias("own"))
    tried = tried.withColumn("back", F.reverse("own"))
    early, late = F.transform(common, lambda s: F.array_position("own", s)), F.transform(common, lambda s: F.size("own") + 1 - F.array_position("back", s))
    tried = tried.select("doc_id", "row", "start", "license", F.size("template").alias("size"), (F.size(common) / F.size("template")).alias("containment"), early.alias("early"), late.alias("late")).where(F.col("containment") >= contained)
    closer = F.array_max("late") - F.array_min("late") < F.array_max("early") - F.array_min("early")
    tried = tried.withColumn("places", F.when(closer, F.col("late")).otherwise(F.col("early")))
    first, last = F.col("start") + F.array_min("places") - 1, F.col("start") + F.array_max("places") - 1 + WIDTH
    found = tried.select("doc_id", "row", F.struct((2 * (last - first) > 3 * (F.col("size") + WIDTH - 1)).cast("int").alias("loose"), (-F.size("early")).alias("fewer"), (-F.col("containment")).alias("less"), (last - first).alias("length"), first.cast("long").alias("first"), last.cast("long").alias("last"), "license").alias("match"))
    kept = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), _winners(F.array_sort(F.collect_list("match"))).alias("kept"))
    kept = kept.select("doc_id", "row", F.explode("kept").alias("match"))
    return kept.groupBy("doc_id", "row", "match.license").agg(F.max(-F.col("match.less")).alias("containment"), F.min("match.first").alias("first_word")).drop("row")


def _winners(matches: Column) -> Column:
    """Of matches in order, best first, those that don't lie on one that has been taken before; the loose ones come last, and touch none."""

    def lies_on(x: Column, y: Column) -> Column:
        common = F.least(x["last"], y["last"]) - F.greatest(x["first"], y["first"])
        return F.when(y["loose"] == 1, common > 0).otherwise(3 * common > 2 * F.least(x["length"], y["length"]))

    none = F.filter(matches, lambda m: F.lit(False))
    return F.aggregate(matches, none, lambda taken, m: F.when(F.exists(taken, lambda t: lies_on(t, m)), taken).otherwise(F.array_append(taken, m)))
