"""License statements by MinHash over overlapping windows, in DataFrame functions alone.

Texts and templates are lower-cased words (letters and digits) in five-word shingles. Templates fall
into size classes c, the powers of two that hold their shingles; a class looks at windows of 2c
shingles that begin at every c-th one, so any run of c shingles lies in a window. A band is one
min-hash: a window with 80 % of a template of more than c / 2 shingles has Jaccard 0.4 / 2.1 or more
with it, so BANDS bands miss with (1 - 0.19)**BANDS, under one in a hundred (``miss_bound``); a verbatim
copy collides surely in small classes. Templates retrieved by a band are then checked: the window must
hold ``PERCENT`` of the template's distinct shingles.

Only windows that hold some shingle of their class's templates can collide, so a document's shingles are
looked up in the table of all templates' shingles first; windows are cut, and their bands computed,
around the hits alone. Templates are a parameter of any number and length: their shingles and bands are
broadcast up to ``BROADCAST_ROWS`` rows, and joined by key beyond.

Statements shorter than a shingle are a parameter of their own: each is one shingle of all its words,
held by a run of just these words.

Defined cases: a null or empty text holds no statement, a text under five words none but short ones;
rows of one doc_id are one document, as are rows with a null doc_id; templates under five words are
refused, as are short statements of five words or none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

PERCENT = 80
BANDS = 24
SHINGLE = 5
#: Template shingles and bands of at most so many rows are broadcast (about 40 bytes a row), as are hits.
BROADCAST_ROWS = 500_000

#: Statements by which common licenses are declared, and some whole texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

#: Statements under five words.
SHORT = [
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License 2.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"),
]


def miss_bound(bands: int = BANDS, percent: int = PERCENT) -> float:
    """The greatest chance that a window that holds ``percent`` of a template shares no band with it."""
    t = percent / 100
    return (1 - t / 2 / (2 + (1 - t) / 2)) ** bands


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def with_shingles(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and ``h``, the hashes of the five-word shingles in order. The words are a column of
    their own first: inside a lambda, an expression would be evaluated for each element."""
    w = words(F.col(text))
    at = F.transform(F.sequence(F.lit(0), F.size("_w") - SHINGLE), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(SHINGLE))))
    h = F.when(F.size("_w") >= SHINGLE, at).otherwise(F.array().cast("array<bigint>"))
    return table.select(*keep, w.alias("_w")).select(*keep, h.alias("h"))


def bands(window: Column) -> Column:
    """BANDS min-hashes of a window."""

    def low(k: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(F.lit(k), x)))

    return F.array(*map(low, range(BANDS)))


def find_short(docs: DataFrame, statements: list[tuple[str, str]], first: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``find``, for statements under five words, numbered from ``first`` on; the window is the first
    word's place."""
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame([(first + k, name, t) for k, (name, t) in enumerate(statements)], "template int, license string, t string")
    table = table.select("template", "license", words(F.col("t")).alias("w")).select("template", "license", F.size("w").alias("n"), F.array_join("w", " ").alias("words"))
    rows = table.collect()
    if any(not 0 < r.n < SHINGLE for r in rows):
        raise ValueError(f"a short statement has one to {SHINGLE - 1} words")

    def places(n: int) -> Column:
        """The runs of ``n`` words that are statements."""
        run = lambda i: F.concat_ws(" ", *(F.get("_w", i + k) for k in range(n)))
        begins = sorted({r.words.split(" ")[0] for r in rows if r.n == n})
        at = F.filter(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.get("_w", i).isin(begins) & run(i).isin([r.words for r in rows if r.n == n]))
        held = F.transform(at, lambda i: F.struct(run(i).alias("words"), i.alias("at")))
        return F.when(F.size("_w") >= n, held).otherwise(F.array().cast("array<struct<words:string,at:int>>"))

    some = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("_w"))
    some = some.select("doc_id", F.explode_outer(F.concat(*map(places, sorted({r.n for r in rows})))).alias("x")).where("x is not null")
    hits = some.select("doc_id", "x.words", "x.at").join(F.broadcast(table), "words")
    best = hits.groupBy("doc_id", "template", "license").agg(F.min("at").alias("window"))
    return best.select("doc_id", "license", "template", F.lit(1).alias("held"), F.lit(1).alias("template_shingles"), "window")


def _few(table: DataFrame) -> DataFrame:
    """A broadcast hint where the counted rows allow it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def find(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, doc_id: str = "doc_id", text: str = "text", short: list[tuple[str, str]] = SHORT) -> DataFrame:
    """``doc_id, license, template, held, template_shingles, window``: per document and template the
    most shingles that a window holds, and the first such window's place in shingles. ``templates``: name
    and text pairs, or a table (template int, license, words). Short statements are numbered after the
    templates."""
    spark: SparkSession = docs.sparkSession
    table = templates if isinstance(templates, DataFrame) else spark.createDataFrame([(k, name, t) for k, (name, t) in enumerate(templates)], "template int, license string, words string")
    table = with_shingles(table, "words", "template", "license").select("template", "license", F.array_distinct("h").alias("t"))
    table = scratch.save(table, "templates")
    if not table.where(F.size("t") == 0).isEmpty():
        raise ValueError("a template needs five words")
    first = 1 + (table.agg(F.max("template")).head()[0] or 0) if not isinstance(templates, list) else len(templates)
    table = table.select("*", F.pow(F.lit(2), F.ceil(F.log2(F.size("t")))).cast("int").alias("c"))
    # rows alike in doc_id and text are one: what they hold is the same
    own = F.struct(F.col(doc_id).alias("doc_id"), F.sha1(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text")).alias("row")
    some = docs.select(own, F.col(text).alias("_t"))

    # which windows of which class hold a shingle of a template: the i-th window of class c begins at i * c and
    # holds 2c shingles, so a shingle lies in two of them
    wanted = _few(scratch.save(table.select("c", F.explode("t").alias("x")).distinct(), "template-shingles"))
    places = with_shingles(some, "_t", "row").select("row", F.posexplode_outer("h").alias("at", "x")).where("x is not null")
    near = places.join(wanted, "x").select("row", "c", F.expr("at div c").cast("int").alias("i"))
    cells = near.select("row", "c", F.explode(F.when(F.col("i") > 0, F.array(F.col("i") - 1, F.col("i"))).otherwise(F.array("i"))).alias("i")).distinct()
    cells = scratch.save(cells.groupBy("row").agg(F.collect_list(F.struct("c", "i")).alias("cells")), "license-windows")

    windows = with_shingles(some.join(_few(cells), "row"), "_t", "row", "cells").select("row", "h", F.explode("cells").alias("k")).select("row", "k.c", (F.col("k.c") * F.col("k.i")).alias("at"), F.slice("h", F.col("k.c") * F.col("k.i") + 1, 2 * F.col("k.c")).alias("w"))
    windows = scratch.save(windows, "license-candidates")
    keyed = windows.select("row", "c", "at", "w", F.posexplode(bands(F.col("w"))).alias("band", "low"))
    known = scratch.save(table.select("template", "license", "c", "t", F.posexplode(bands(F.col("t"))).alias("band", "low")), "template-bands")
    held = F.size(F.array_intersect("w", "t"))
    hits = keyed.join(_few(known), ["c", "band", "low"]).select("row", "at", "template", "license", held.alias("held"), F.size("t").alias("n"))
    hits = hits.where(100 * F.col("held") >= PERCENT * F.col("n"))
    best = hits.groupBy(F.col("row.doc_id").alias("doc_id"), "template", "license", "n").agg(F.max(F.struct("held", (-F.col("at")).alias("back"))).alias("m"))
    best = best.select("doc_id", "license", "template", F.col("m.held").alias("held"), F.col("n").alias("template_shingles"), (-F.col("m.back")).alias("window"))
    return best.union(find_short(docs, short, first, doc_id, text)) if short else best
