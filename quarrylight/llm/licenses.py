"""License scans: TF-IDF cosine to templates, then inheritance by directory.

Built-in functions only. A document's header and its other blocks (lines between
blank ones, without their comment marks), the lines and sentences of those, and a
licence file's whole text become sparse vectors of word pairs weighted by TF-IDF,
with document frequencies over the templates. The cosine to each template is a
join on the pairs. Files without a licence of their own inherit that of the
nearest directory above which has a licence file: each directory is joined with
its ancestors, and the deepest wins.

What can't reach the least similarity is left out before the join, by a bound and
not by a guess: the cosine is at most the length of the part of a template's
vector whose pairs the notice has. ``gate_words`` finds words such that of every
template the pairs without any of them are too short a part, so a notice without
any of these words can't match.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import materialize

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Identifiers, and the notices by which a header states them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("Proprietary", "All rights reserved."),
    # whole files, and the titles of those that are too long to be held here
    ("MIT", f"MIT License Copyright (c) {_MIT}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    # paragraphs of headers
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
)
#: Identifier, further SPDX tags, and the names by which texts call the licence.
_NAMES = (
    ("Apache-2.0", (), ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license")),
    ("MIT", (), ("MIT License",)),
    ("BSD-2-Clause", (), ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", (), ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License")),
    ("ISC", (), ("ISC License",)),
    ("MPL-2.0", (), ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0 license")),
    ("EPL-2.0", (), ("Eclipse Public License, Version 2.0", "Eclipse Public License v2.0")),
    ("Unlicense", (), ("Unlicense license",)),
    ("CC0-1.0", (), ("CC0 1.0 Universal license", "Creative Commons CC0 1.0 Universal Public Domain Dedication")),
    ("CC-BY-4.0", (), ("CC BY 4.0 license", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", (), ("CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", (), ("CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License")),
) + tuple(
    (f"{short}-{v}", (f"{short}-{v}-only", f"{short}-{v}-or-later", f"{short}-{v}+"), (f"GNU {long}General Public License, version {n}", f"GNU {long}General Public License v{n}", f"{short} version {n} license", f"{short} v{n} license", f"{short}v{n} license"))
    for short, long, v, n in (
        ("GPL", "", "2.0", "2"), ("GPL", "", "3.0", "3"), ("LGPL", "Lesser ", "2.1", "2.1"), ("LGPL", "Lesser ", "3.0", "3"), ("AGPL", "Affero ", "3.0", "3"),
    )
)
_PHRASES = (
    "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This file is available under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.",
    "This software is released under the terms of the {}.", "This project is licensed under the {} - see the LICENSE file for details.", "under the {}.", "{}",
)


def _paragraph(long: str, version: str) -> str:
    return f"you can redistribute it and/or modify it under the terms of the GNU {long}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


#: What common licences have in headers and files, in words that aren't made of names.
_TEXTS = (
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {_BSD_2} {_AS_IS}"),
    ("BSD-2-Clause", _BSD_2),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", f"This program is free software; {_paragraph('', '2')}"),
    ("LGPL-2.1", f"This library is free software; {_paragraph('Lesser ', '2.1')}"),
    ("LGPL-3.0", f"This library is free software: {_paragraph('Lesser ', '3')}"),
    ("AGPL-3.0", f"This program is free software: {_paragraph('Affero ', '3')}"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
TEMPLATES += _TEXTS + tuple((i, f"SPDX-License-Identifier: {x}") for i, more, _ in _NAMES for x in (i, *more)) + tuple((i, p.format(x)) for i, _, names in _NAMES for x in names for p in _PHRASES)
#: Marks of comments at the ends of a line.
_HEAD, _TAIL = r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+)?[ \t]*", r"[ \t\r]*(?:\*+/|-->)?[ \t\r]*\z"
_LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
_WORD = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.6
#: Short words that many texts have.
_COMMON = ("a", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "copy", "for", "form", "from", "has", "if", "in", "into", "is", "it", "no", "not", "of", "on", "one", "only", "or", "see", "than", "that", "the", "this", "to", "under", "use", "was", "with", "work", "you")


def template_vectors(values=TEMPLATES) -> list[tuple[int, str, str, float, float]]:
    """(template, license, pair, idf, weight): unit vectors of the templates, a
    constant table of some thousand rows."""
    counted = []
    for _, notice in values:
        words = re.findall(_WORD, notice.lower())
        counted.append(Counter([f"{a} {b}" for a, b in zip(words, words[1:])] if len(words) > 1 else words))  # noqa: B905
    df = Counter(pair for c in counted for pair in c)
    out = []
    for i, c in enumerate(counted):
        weighed = {pair: tf * math.log1p(len(values) / df[pair]) for pair, tf in c.items()}
        norm = math.sqrt(sum(w * w for w in weighed.values()))
        out += [(i, values[i][0], pair, math.log1p(len(values) / df[pair]), w / norm) for pair, w in weighed.items()]
    return out


def gate_words(vectors: list[tuple[int, str, str, float, float]], least: float = LEAST) -> list[str]:
    """Words of which any text that is ``least`` similar to a template has one.

    Greedy: the word next that takes most of what the templates still have too
    much of. Words that are common in other texts come last; that choice is for
    speed alone.
    """
    left: dict[int, dict[str, float]] = {}
    for template, _, pair, _, weight in vectors:
        left.setdefault(template, {})[pair] = weight * weight
    # a little under the bound, for sums in another order
    bound, chosen = least * least * 0.98, []
    while over := {t: pairs for t, pairs in left.items() if sum(pairs.values()) >= bound}:
        gain: Counter[str] = Counter()
        for pairs in over.values():
            for pair, part in pairs.items():
                gain.update(dict.fromkeys(pair.split(), part))
        word = max(gain, key=lambda w: (len(w) > 5, w not in _COMMON, len(w) > 1, gain[w] * len(w), w))
        chosen.append(word)
        left = {t: {p: x for p, x in pairs.items() if word not in p.split()} for t, pairs in over.items()}
    return chosen


def _any_of(words: dict[str, str]) -> str:
    """A pattern for any of the words, each with what must follow it, that reads
    a common beginning once."""
    if len(words) == 1:
        word, tail = next(iter(words.items()))
        return re.escape(word) + tail
    by: dict[str, dict[str, str]] = {}
    for word, tail in sorted(words.items()):
        by.setdefault(word[:1], {})[word[1:]] = tail
    return "(?:" + "|".join([re.escape(c) + _any_of(rest) for c, rest in by.items() if c] + [rest[""] for rest in [by.get("")] if rest]) + ")"


def gate_pattern(vectors: list[tuple[int, str, str, float, float]], words: list[str]) -> str:
    """One pattern for lower-case texts that have a gate word. Short words count
    only in the pairs that templates have of them."""
    long = [w for w in words if len(w) > 4]
    short = {w for w in words if len(w) < 5}
    after: dict[str, set[str]] = {}
    for pair in {v[2] for v in vectors}:
        if short & set(pair.split()) and not any(w in pair for w in long):
            first, _, second = pair.partition(" ")
            after.setdefault(first, set()).add(second)
    tails = {a: "(?![a-z0-9])" if "" in bs else "[^a-z0-9]+" + _any_of(dict.fromkeys(bs, "(?![a-z0-9])")) for a, bs in after.items()}
    return "(?:^|[^a-z0-9])" + _any_of(tails | dict.fromkeys(long, ""))


def _notices(lines: Column, is_license_file: Column, gate) -> Column:
    """The texts of a document that may state a licence: its lines, blocks, and
    the sentences of blocks, whole and from "under" on (what a sentence says of
    its subject doesn't count); a licence file also as a whole."""
    plain = F.array_join(lines, "\n")
    blocks = F.transform(F.filter(F.split(plain, "\n\n+"), gate), lambda x: F.translate(x, "\n", " "))
    marked = F.transform(blocks, lambda x: F.regexp_replace(x, r"([.!?])[ \t\r]+", "$1\n"))
    sentences = F.filter(F.flatten(F.transform(marked, lambda x: F.split(x, "\n"))), gate)
    tails = F.filter(F.transform(sentences, lambda x: F.regexp_extract(x, r"\bunder\s.*", 0)), gate)
    whole = F.when(is_license_file, F.array(F.translate(plain, "\n", " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(lines, gate), blocks, sentences, tails, whole))


def stated_licenses(files: DataFrame, values=TEMPLATES, least: float = LEAST) -> DataFrame:
    """file_id, path, license, similarity of each file that states a licence.

    Every notice is compared as a vector of its own; the most similar template of
    all wins (ties: the licence by name), a reserved right only
    where no licence is granted. Pairs that no template has count in a notice's
    norm with the weight of a template's rarest pair. Nulls in file_id and path
    are values like others; a null or empty text states nothing. Rows that repeat
    a file_id and path have all their statements together. No files: no rows.
    """
    vectors = template_vectors(values)
    pattern = gate_pattern(vectors, gate_words(vectors, least))

    def gate(x: Column) -> Column:
        return x.rlike(pattern)

    table = materialize(files.sparkSession.createDataFrame(vectors, "template int, license string, pair string, idf double, weight double").coalesce(1), "templates")
    is_license_file = F.coalesce(F.col("path").rlike(_LICENSE_FILE), F.lit(False))
    rows = files.select(files["file_id"].alias("file_id"), files["path"].alias("path"), files["text"].alias("text")).filter(gate(F.lower("text")))
    # columns of their own, so that nothing computes them again for each notice
    split = F.transform(F.split(F.translate("text", _UPPER, _LOWER), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, _HEAD, ""), _TAIL, ""))
    found = rows.select("file_id", "path", split.alias("lines")).select("file_id", "path", F.explode(_notices(F.col("lines"), is_license_file, gate)).alias("notice"))
    # a number stands for the notice from here on, however long it is
    found = found.select("file_id", "path", F.xxhash64("notice").alias("part"), F.regexp_extract_all("notice", F.lit(f"({_WORD})"), F.lit(1)).alias("words"))
    n = F.size("words")
    pairs_of = F.zip_with(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    key = ["file_id", "path", "part"]
    each = found.filter(n > 0).select(*key, F.explode(F.when(n > 1, pairs_of).otherwise(F.col("words"))).alias("pair")).select(*key, F.xxhash64("pair").alias("pair"))
    # all of a notice in one task, where it is counted, weighed and, mostly, let go
    tf = each.repartition("part").groupBy(*key, "pair").agg(F.count("*").alias("tf"))
    # the template table is a constant of this module: some thousand pairs
    table = table.withColumn("pair", F.xxhash64("pair"))
    idf = table.groupBy("pair").agg(F.first("idf").alias("idf"))
    weighted = tf.join(F.broadcast(idf), "pair", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(math.log1p(len(values)))))
    known = F.col("idf").isNotNull()
    square = F.col("w") * F.col("w")
    vector = weighted.groupBy(*key).agg(F.sum(square).alias("all"), F.sum(F.when(known, square)).alias("known"), F.collect_list(F.when(known, F.struct("pair", "w"))).alias("has"))
    # the cosine to any template is at most the part of the norm that known pairs have
    near = vector.filter(F.col("known") >= F.col("all") * (least * least * 0.98))
    sides = near.select(*key, F.sqrt("all").alias("norm"), F.inline("has")).join(F.broadcast(table.select("pair", "template", "license", "weight")), "pair")
    dots = sides.groupBy(*key, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.select(*key, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).filter(F.col("similarity") >= least)
    best = F.max(F.struct((F.col("license") != "Proprietary").alias("granted"), "similarity", "license"))
    return scored.groupBy("file_id", "path").agg(best.alias("b")).select("file_id", "path", "b.license", "b.similarity")


def _ancestors(path: Column) -> Column:
    """(directory, depth) of a path's directories, the root '' with depth 0."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))


def license_scan(files: DataFrame, values=TEMPLATES, least: float = LEAST) -> DataFrame:
    """file_id, path, license, similarity, origin for every row of ``files``.

    Needs file_id, path and text, whatever other columns there are. origin is
    ``stated`` (in the file), ``inherited`` (from the licence file of the nearest
    directory above, the own included) or ``none``. A null path has no directory;
    a null text states nothing; a null file_id is a value like others, so its row
    states, grants and inherits. Rows that repeat a file_id and path share the
    best statement. Of several licence files in a directory the most similar
    counts, then the licence by name. No files: no rows.
    """
    stated = materialize(stated_licenses(files, values, least), "licenses").toDF("stated_id", "stated_path", "license", "similarity")
    rows = files.select(files["file_id"].alias("file_id"), files["path"].alias("path"))
    directory = F.regexp_replace("stated_path", r"/?[^/]*$", "")
    granting = stated.filter(F.col("stated_path").rlike(_LICENSE_FILE))
    grants = granting.groupBy(directory.alias("dir")).agg(F.max(F.struct("similarity", "license")).alias("g")).select("dir", F.col("g.license").alias("granted"))
    own = F.regexp_replace("path", r"/?[^/]*$", "")
    dirs = rows.filter("path is not null").select(own.alias("own")).distinct()
    # directories, not files, are joined with what lies above them
    above = dirs.select("own", F.explode(_ancestors(F.concat("own", F.when(F.col("own") == "", F.lit("x")).otherwise(F.lit("/x"))))).alias("a"))
    nearest = above.join(grants, F.col("a.dir") == F.col("dir")).groupBy("own").agg(F.max(F.struct(F.col("a.depth").alias("depth"), "granted")).alias("n"))
    # a table of its own, so that a directory with many files can be split in the join
    nearest = materialize(nearest.select(F.col("own").alias("near"), F.col("n.granted").alias("granted")), "nearest")
    placed = rows.join(stated, F.col("file_id").eqNullSafe(F.col("stated_id")) & F.col("path").eqNullSafe(F.col("stated_path")), "left")
    out = placed.withColumn("own", own).join(nearest, F.col("own") == F.col("near"), "left")
    origin = F.when(F.col("license").isNotNull(), "stated").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", "path", F.coalesce("license", "granted").alias("license"), "similarity", origin.alias("origin"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The driver's documents as a tree: source/ten thousands/thousands/id.txt,
    and of every hundred the first as that directory's LICENSE file."""
    i = F.col("doc_id")
    base = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), (F.floor(i / 1000) % 10).cast("string"), (F.floor(i / 100) % 10).cast("string"))
    path = F.when(i % 100 == 0, F.concat(base, F.lit("/LICENSE"))).otherwise(F.concat(base, F.lit("/"), i.cast("string"), F.lit(".txt")))
    return docs.select(docs["doc_id"].alias("file_id"), path.alias("path"), docs["text"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The scan of ``documents_as_files`` in DuckDB, without the gate.
ORACLE = rf"""
WITH templates AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))}) AS v(template, license, text)),
t_words AS (SELECT template, license, regexp_extract_all(lower(text), '{_WORD}') AS w FROM templates),
t_pairs AS (
  SELECT template, license, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS pair FROM t_words),
t_tf AS (SELECT template, license, pair, count(*) AS tf FROM t_pairs GROUP BY ALL),
t_idf AS (SELECT pair, ln(1 + {len(TEMPLATES)}.0::DOUBLE / count(*)) AS idf FROM t_tf GROUP BY pair),
t_norm AS (SELECT template, sqrt(sum(tf * idf * tf * idf)) AS norm FROM t_tf JOIN t_idf USING (pair) GROUP BY template),
vectors AS (SELECT template, license, pair, tf * idf / norm AS weight FROM t_tf JOIN t_idf USING (pair) JOIN t_norm USING (template)),
based AS (
  SELECT doc_id, text, coalesce(source, 'unknown') || '/' || ((doc_id // 1000) % 10) || '/' || ((doc_id // 100) % 10) AS dir FROM documents),
files AS (
  SELECT doc_id, text, dir, CASE WHEN doc_id % 100 = 0 THEN dir || '/LICENSE' ELSE dir || '/' || doc_id || '.txt' END AS path FROM based),
lined AS (
  SELECT doc_id, path, list_transform(string_split(translate(text, '{_UPPER}', '{_LOWER}'), chr(10)),
         lambda x: regexp_replace(regexp_replace(x, '{_HEAD}', ''), '{_TAIL}', '')) AS ls FROM files WHERE text IS NOT NULL),
blocks AS (
  SELECT doc_id, path, replace(unnest(regexp_split_to_array(array_to_string(ls, chr(10)), '\n\n+')), chr(10), ' ') AS b FROM lined),
sentences AS (
  SELECT doc_id, path, unnest(string_split(regexp_replace(b, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM blocks),
notices AS (
  SELECT doc_id, path, unnest(ls) AS notice FROM lined UNION SELECT doc_id, path, b FROM blocks UNION SELECT doc_id, path, s FROM sentences
  UNION SELECT doc_id, path, regexp_extract(s, '\bunder\s.*', 0) FROM sentences
  UNION SELECT doc_id, path, replace(array_to_string(ls, chr(10)), chr(10), ' ') FROM lined WHERE path LIKE '%/LICENSE'),
n_words AS (SELECT doc_id, path, notice, regexp_extract_all(notice, '{_WORD}') AS w FROM notices),
n_pairs AS (
  SELECT doc_id, path, notice, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS pair FROM n_words),
n_tf AS (SELECT doc_id, path, notice, pair, count(*) AS tf FROM n_pairs GROUP BY ALL),
n_w AS (SELECT doc_id, path, notice, pair, tf * coalesce(idf, ln(1 + {len(TEMPLATES)}.0::DOUBLE)) AS w FROM n_tf LEFT JOIN t_idf USING (pair)),
n_norm AS (SELECT doc_id, path, notice, sqrt(sum(w * w)) AS norm FROM n_w GROUP BY ALL),
dots AS (SELECT doc_id, path, notice, template, license, sum(w * weight) AS dot FROM n_w JOIN vectors USING (pair) GROUP BY ALL),
scored AS (
  SELECT doc_id, path, license, round(dot / norm, 6) AS similarity FROM dots JOIN n_norm USING (doc_id, path, notice) WHERE round(dot / norm, 6) >= {LEAST}::DOUBLE),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY license <> 'Proprietary' DESC, similarity DESC, license DESC) AS place FROM scored),
stated AS (SELECT doc_id, license, similarity FROM ordered WHERE place = 1),
granting AS (
  SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license DESC) AS place FROM files JOIN stated USING (doc_id) WHERE path LIKE '%/LICENSE'),
grants AS (SELECT dir, license AS granted FROM granting WHERE place = 1)
SELECT doc_id, path, coalesce(license, granted) AS license, similarity,
       CASE WHEN license IS NOT NULL THEN 'stated' WHEN granted IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM files LEFT JOIN stated USING (doc_id) LEFT JOIN grants USING (dir)
"""
