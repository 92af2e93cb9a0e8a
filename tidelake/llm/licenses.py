"""Operator 10, licence scans by the Dice coefficient over word bigrams, with DataFrame functions alone.

Texts are scanned line by line. A line is normalised (lower case, runs of other characters than letters and digits become one space) and compared with
templates of licence notices: twice the number of distinct word bigrams in common over the sum of both numbers. As that can't reach the
threshold when one number is over (2 - t) / t times the other, a line is compared with the templates of its size alone. A match also lacks so few of
a template's bigrams that it must hold one of a few of them (anchors); texts and lines without any drop out before they are split.

Notices that aren't a line of their own (wrapped, commented, amid other sentences) are found by windows: line breaks ignored, as many words as a template
has, from each of its bigrams on, templates of whole paragraphs among them. A window of which more than half lies in lines that match gives way to these; of windows that
overlap, the one with the most bigrams in common stays, then the one with the fewest of its own, then the first by name and place. It is reported at the line where it begins, as normalised text.

Defined cases: null and empty texts match nothing. A line of one word has no bigram and matches nothing. Rows that repeat an id are scanned each. Of
templates with equal coefficients the first by name counts. An empty table gives an empty result. Other columns are passed by.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch

#: Least coefficient of a match, in hundredths.
PERCENT = 80

# Names and the usual wording of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 long": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT long": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

# Whole paragraphs, compared with windows alone.
PARAGRAPHS = {
    "Apache-2.0 paragraph": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause paragraph": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause paragraph": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0 paragraph": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "ISC paragraph": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT paragraph": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0 paragraph": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


#: Words that stand in any text; pairs of two of them are the last to be taken as anchors.
COMMON = frozenset("of to in the that with this is a be for and by or on as it an at from are".split())


def bigrams(text: str) -> list[str]:
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def needed(size: int, percent: int = PERCENT) -> int:
    """Of a template's bigrams those that any match has at least."""
    return -(-size * percent // (200 - percent))


def anchors(templates: dict[str, list[str]], percent: int = PERCENT) -> list[str]:
    """Bigrams of which every match of any template holds one: of each template, one more than a match may lack. Those that serve several templates are taken first, pairs of common words last, as these let any text through."""
    uses = Counter(b for own in templates.values() for b in own)
    chosen: dict[str, None] = {}
    for own in sorted(templates.values(), key=len):
        short = len(own) - needed(len(own), percent) + 1 - sum(b in chosen for b in own)
        free = sorted((b for b in own if b not in chosen), key=lambda b: (COMMON.issuperset(b.split()), -uses[b], -len(b), b))
        chosen.update(dict.fromkeys(free[: max(0, short)]))
    return list(chosen)


def normalise(text: Column) -> Column:
    """Lower case, with a space for each run of characters other than a-z and 0-9, and one at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, paragraphs: dict[str, str] = PARAGRAPHS) -> DataFrame:
    """A row for each line, or window over lines, that matches a template: doc_id, line_no (from 1), line, license, common, n_line, n_template (numbers of distinct bigrams). The best template counts."""
    own = {k: b for k, v in sorted(templates.items()) if (b := bigrams(v))}
    every = {k: v for k, v in sorted((templates | paragraphs).items()) if bigrams(v)}
    held = lambda c, among=own: reduce(lambda a, b: a | b, (F.contains(F.col(c), F.lit(f" {b} ")) for b in anchors(among, percent)))
    tmp = Scratch(docs.sparkSession, "licenses")
    # explode(array(x)) computes x once for all that uses it below
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.explode(F.array(normalise(F.col(text)))).alias("norm")).where(held("norm", {k: bigrams(v) for k, v in every.items()}))
    docs = tmp.cut(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "texts")
    lines = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("*", F.explode(F.array(normalise(F.col("line")))).alias("norm")).where(held("norm"))
    words = F.split(F.trim("norm"), " ")
    lines = lines.select("row", "doc_id", "line_no", "line", F.explode(F.array(words)).alias("words")).where("size(words) > 1")
    pair = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    lines = lines.select("row", "doc_id", "line_no", "line", F.explode(F.array(F.array_distinct(pair))).alias("pairs"))
    n = F.size("pairs")
    known = F.array(*(F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, b)).alias("own"), F.lit(len(b)).alias("n")) for k, b in own.items()))
    near = F.filter(known, lambda t: (n * (200 - percent) >= t["n"] * percent) & (n * percent <= t["n"] * (200 - percent)))
    scored = F.transform(near, lambda t: F.struct(F.size(F.array_intersect("pairs", t["own"])).alias("common"), t["license"].alias("license"), t["n"].alias("n_template")))
    good = F.filter(scored, lambda t: 200 * t["common"] >= percent * (n + t["n_template"]))
    better = lambda a, x: F.when(a.isNull() | (x["common"] * (n + a["n_template"]) > a["common"] * (n + x["n_template"])), x).otherwise(a)
    best = F.aggregate(good, F.lit(None).cast("struct<common: int, license: string, n_template: int>"), better)
    found = lines.select("row", "doc_id", "line_no", "line", n.alias("n_line"), F.explode(F.array(best)).alias("best")).where("best IS NOT NULL")
    found = found.select("row", "doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line", "best.license", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("best.common", "n_line", "best.n_template")))
    found = tmp.cut(found, "lines")
    wide = windows(docs, every, percent).join(found.groupBy("row").agg(F.collect_set("line_no").alias("matched")), "row", "left")
    inside = F.size(F.filter("lines", lambda x: F.array_contains(F.coalesce("matched", F.array().cast("array<long>")), x)))
    return found.drop("row").union(apart(wide.where(2 * inside <= F.size("lines"))).select(found.drop("row").columns))


def windows(docs: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    """All windows of docs (row, doc_id, text) that match a template, with start and stop (words from 0) and the line of each word."""
    known = []
    for name, wording in templates.items():
        own, span = bigrams(wording), len(re.sub(r"[^a-z0-9]+", " ", wording.lower()).split()) - 1
        known.append(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("own"), F.lit(len(own)).alias("n"), F.lit(span).alias("span"), F.lit(needed(len(own), percent)).alias("least")))
    by_line = F.transform(F.split("text", "\n"), lambda x: F.filter(F.split(F.trim(normalise(x)), " "), lambda w: w != ""))
    docs = docs.select("row", "doc_id", F.explode(F.array(by_line)).alias("by_line"))
    of = F.flatten(F.transform("by_line", lambda x, i: F.array_repeat((i + 1).cast("long"), F.size(x))))
    docs = docs.select("row", "doc_id", F.explode(F.array(F.struct(F.flatten("by_line").alias("words"), of.alias("of")))).alias("x")).select("row", "doc_id", "x.*").where("size(words) > 1")
    pair = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    docs = docs.select("*", F.explode(F.array(pair)).alias("pairs"))
    docs = docs.select("*", F.explode(F.filter(F.array(*known), lambda t: F.size(F.array_intersect("pairs", t["own"])) >= t["least"])).alias("t"))
    hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains(F.col("t.own"), F.get("pairs", i)))
    docs = docs.select("*", F.explode(F.array(hits)).alias("hits"))
    # as many hits as a match needs must lie within the window
    starts = F.filter("hits", lambda h, j: F.coalesce(F.get("hits", j + F.col("t.least") - 1) < h + F.col("t.span"), F.lit(False)))
    docs = docs.select("row", "doc_id", "words", "of", "pairs", "t", F.explode(starts).alias("start"))
    cut = lambda c, more=0: F.slice(c, F.col("start") + 1, F.col("t.span") + more)
    docs = docs.select("row", "doc_id", "start", "t.license", F.col("t.n").alias("n_template"), cut("words", 1).alias("words"), cut("of", 1).alias("lines"), F.size(F.array_intersect(cut("pairs"), "t.own")).alias("common"), F.size(F.array_distinct(cut("pairs"))).alias("n_line"))
    return docs.where(200 * F.col("common") >= percent * (F.col("n_line") + F.col("n_template"))).withColumn("stop", F.col("start") + F.size("words"))


def apart(wide: DataFrame) -> DataFrame:
    """Of windows that overlap, one."""
    kept = ["license", "start", "stop", F.array_join("words", " ").alias("line"), F.get("lines", F.lit(0)).alias("line_no"), *(F.col(c).cast("long").alias(c) for c in ("common", "n_line", "n_template"))]
    each = F.struct((-F.col("common")).alias("a"), F.col("n_line").alias("b"), *kept)
    row = wide.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(each)).alias("x"))
    free = lambda chosen, w: ~F.exists(chosen, lambda c: (c["start"] < w["stop"]) & (w["start"] < c["stop"]))
    chosen = F.aggregate("x", F.filter("x", lambda _: F.lit(False)), lambda got, w: F.when(free(got, w), F.array_append(got, w)).otherwise(got))
    return row.select("doc_id", F.explode(chosen).alias("w")).select("doc_id", "w.*")


def sql(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    """scan()'s digest in DuckDB, without the bounds and anchors."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, bigrams(v)))}])" for k, v in sorted(templates.items()))
    return rf"""
WITH t(license, own) AS (VALUES {rows}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM l),
p AS (SELECT doc_id, line, line_no, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pairs FROM w WHERE len(ws) > 1),
s AS (SELECT doc_id, line_no, license, len(list_intersect(pairs, own)) AS common, len(pairs) AS n_line, len(own) AS n_template FROM p, t WHERE len(list_intersect(pairs, own)) > 0),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY 200.0 * common / (n_line + n_template) DESC, license) AS k FROM s WHERE 200 * common >= {percent} * (n_line + n_template))
SELECT doc_id, line_no::BIGINT AS line_no, license, common::BIGINT AS common, n_line::BIGINT AS n_line, n_template::BIGINT AS n_template FROM m WHERE k = 1
"""
