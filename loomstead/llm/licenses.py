"""Licence scans in DataFrame functions only: TF-IDF cosine of lines and windows to templates, then inheritance by directory.

A line is a vector over the words of the templates: counts times ln((1 + lines) / (1 + lines with the word)) + 1. All its
other words count as words that no line has, once for each occurrence, so they only lengthen it. A line bears the licence
of the template with the largest cosine, if that is at least `least`. So does a sentence, and for templates of ten words or more a window: as
many words as the template has, from one of its words on, over the whole text, so that wrapped, commented and embedded notices
are found, and short forms only where they stand for themselves; lines alone are counted for weights. A part that denies something, with a word
that a template has not got, does not bear the template's licence. A tag that names a known licence is as good as its whole text. A
file bears the licence of its best part; whole licence texts (60 words and more, at a cosine of 0.85) come before the notices that several
licences share. Files named like licences grant theirs to their directory. A file without a licence of its own inherits from its nearest
directory that grants one, found by joining all its ancestor directories.

Defined results: null or empty text bears none; rows of equal path are one file, and so are those with a null path, which
inherit nothing; equal cosines go to the licence first by name, equal grants of a directory to the path first by code point;
an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import fresh, settled, sized_join, written

#: Licences and what announces them: notices and headers, short forms, titles, and the whole text of the short
#: licences (their own published wording).
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
        BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    (
        "LGPL-3.0",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
NAMES = r"(?i)^(licen[sc]e|copying)([.-].*)?$"
WORD = r"[^\p{L}\p{N}]+"
LEAST = 0.75
#: Words of templates that windows look for, and of whole licence texts, with the cosine from which on these come first.
WINDOWED, WHOLE, WHOLE_LEAST = 10, 60, 0.85
#: Words that deny.
DENIALS = ("aren", "don", "isn", "never", "nor", "not", "wasn", "weren")
#: A tag with the name of a licence, whose additions (-only, -or-later, +) are not told apart.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"


def template_words(text: str) -> Counter:
    return Counter(w for w in re.split(r"[^a-z0-9]+", text.lower()) if w)


VOCABULARY = sorted({w for _, text in TEMPLATES for w in template_words(text)})


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), WORD), lambda w: w != "")


def _known(units: DataFrame) -> DataFrame:
    words = units.withColumn("known", F.filter("words", lambda w: w.isin(*VOCABULARY)))  # looked up in a set, not in a list
    return words.select("path", F.size("words").alias("n"), "known", F.exists("words", lambda w: w.isin(*DENIALS)).alias("denies")).filter("n > 0")


def _lines(files: DataFrame, text: str, path: str) -> DataFrame:
    lines = files.select(F.col(path).alias("path"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"))
    return _known(lines.select("path", _words(F.col("line")).alias("words")))


def _sentences(able: DataFrame, least: float) -> DataFrame:
    """Sentences for the short templates: with more words than 1 / least^2 times a template's, most of them unknown, none is near enough."""
    sizes = {i: sum(template_words(body).values()) for i, (_, body) in enumerate(TEMPLATES, 1)}
    short = {i: n for i, n in sizes.items() if n < WINDOWED}
    rows = able.filter(F.exists("able", lambda i: i.isin(*short))).select("path", F.explode(F.split("text", r"(?<=[.!?;])\s+")).alias("sentence"))
    rows = rows.select("path", _words(F.col("sentence")).alias("words"))
    return _known(rows.filter(F.size("words") <= math.ceil(max(short.values()) / least**2)))


def _tags(files: DataFrame, text: str, path: str) -> DataFrame:
    """path, b: files with a tag that names a known licence, as if it were a whole text that fits."""
    named = F.regexp_replace(F.regexp_extract(F.col(text), TAG, 1), r"(-only|-or-later|\+)$", "")
    known = {n.lower(): n for n, _ in TEMPLATES if n != "Proprietary"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]), F.lower(named))
    rows = files.filter(F.contains(F.col(text), F.lit("SPDX-License-Identifier"))).select(F.col(path).alias("path"), name.alias("licence")).filter("licence IS NOT NULL")
    return rows.select("path", F.struct(F.lit(-2.0).alias("far"), "licence", F.lit(1.0).alias("cosine")).alias("b"))


def _able(files: DataFrame, text: str, path: str, idf: dict[str, float], least: float) -> DataFrame:
    """path, text, able: the templates (from 1) that a part of a text can be near to, and the texts that have any. The cosine
    of a part is at most the length of the template's unit vector over the words that the text has, so none is lost."""
    texts = files.select(F.col(path).alias("path"), F.col(text).alias("text")).filter("text IS NOT NULL")
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    texts = texts.withColumn("has", settled(F.array_intersect(F.split(F.lower("text"), WORD), vocabulary)))
    able = []
    for i, (_, body) in enumerate(TEMPLATES, 1):
        t = {w: (k * idf[w]) ** 2 for w, k in template_words(body).items()}
        share = F.create_map(*[F.lit(x) for w, y in sorted(t.items()) for x in (w, y / sum(t.values()))])
        most = F.aggregate("has", F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(share, w), F.lit(0.0)))
        able.append(F.when(most >= (least - 1e-6) ** 2, F.lit(i)))
    return texts.withColumn("able", settled(F.array_compact(F.array(*able)))).filter("size(able) > 0").select("path", "text", "able")


def _windows(able: DataFrame) -> DataFrame:
    bodies = [template_words(body) for _, body in TEMPLATES]
    own = F.array(*[F.array(*[F.lit(w) for w in sorted(b)]) for b in bodies])
    size = F.array(*[F.lit(sum(b.values())) for b in bodies])
    long_ = [i for i, b in enumerate(bodies, 1) if sum(b.values()) >= WINDOWED]
    able = able.withColumn("able", F.filter("able", lambda i: i.isin(*long_))).filter("size(able) > 0")
    rows = able.select("path", settled(_words(F.col("text"))).alias("words"), "able").filter("size(words) > 0").withColumn("i", F.explode("able"))
    rows = rows.select("path", "words", F.element_at(own, F.col("i")).alias("own"), F.element_at(size, F.col("i")).alias("size"))
    start = F.filter(F.sequence(F.lit(1), F.size("words")), lambda j: F.array_contains(F.col("own"), F.element_at("words", j)))
    rows = rows.withColumn("starts", settled(start))
    return _known(rows.select("path", F.explode(F.transform("starts", lambda j: F.slice("words", j, F.col("size")))).alias("words")))


def _dot(share: Column) -> Column:
    return F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * F.coalesce(F.element_at(share, e["w"]), F.lit(0.0)))


def scan(files: DataFrame, text: str = "text", path: str = "path", least: float = LEAST) -> DataFrame:
    """path, licence, cosine of every file that bears a licence."""
    lines = _lines(files, text, path)
    held = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct("known"))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    df = {r.w: r.k for r in held.collect()}  # a row a word of the templates, and one for all lines
    n_lines = df.get("", 0)
    idf = {w: math.log((1 + n_lines) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
    none = math.log(1 + n_lines) + 1
    weight = F.create_map(*[F.lit(x) for w in VOCABULARY for x in (w, idf[w])])
    times = lambda w: F.size(F.filter("known", lambda x: x == w)).cast("double")
    vector = F.transform(F.array_distinct("known"), lambda w: F.struct(w.alias("w"), (times(w) * F.element_at(weight, w)).alias("x")))
    able = written(_able(files, text, path, idf, least), "licence-texts")
    lines = _lines(able, "text", "path").unionByName(_sentences(able, least)).unionByName(_windows(able))
    lines = lines.filter(F.size("known") > 0).withColumn("v", settled(vector))
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"])
    lines = lines.withColumn("inside", square).withColumn("norm", F.sqrt(F.col("inside") + (F.col("n") - F.size("known")) * none * none))
    lines = lines.filter(F.col("inside") >= least * least * F.col("norm") * F.col("norm"))  # no template can be nearer
    found = []
    for name, body in TEMPLATES:
        t = {w: k * idf[w] for w, k in template_words(body).items()}
        length = math.sqrt(sum(x * x for x in t.values()))
        share = F.create_map(*[F.lit(x) for w, y in sorted(t.items()) for x in (w, y / length)])
        cosine = F.round(_dot(share) / F.col("norm"), 6)
        if not set(DENIALS) & t.keys():
            cosine = F.when(F.col("denies"), F.lit(0.0)).otherwise(cosine)
        found.append(cosine)
    near = lines.select("path", settled(F.array(*found)).alias("cosines"))
    whole = {i for i, (_, body) in enumerate(TEMPLATES, 1) if sum(template_words(body).values()) >= WHOLE}
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    ranked = lambda c, i: F.struct((-c - F.when((i + 1).isin(*whole) & (c >= WHOLE_LEAST), 1.0).otherwise(0.0)).alias("far"), F.get(names, i).alias("licence"), c.alias("cosine"))
    best = near.select("path", F.array_min(F.transform("cosines", ranked)).alias("b")).filter(F.col("b.cosine") >= least)
    best = best.unionByName(_tags(files, text, path))
    return best.groupBy("path").agg(F.min("b").alias("b")).select("path", "b.licence", "b.cosine")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def licences(files: DataFrame, text: str = "text", path: str = "path", least: float = LEAST) -> DataFrame:
    """files with own_licence, licence (its own, else inherited) and granted_by (the directory it is inherited from)."""
    borne = written(scan(files, text, path, least), "licences")
    name = F.element_at(parts(F.col("path")), -1)
    folder = F.when(F.size(parts(F.col("path"))) > 1, F.array_join(F.slice(parts(F.col("path")), 1, F.size(parts(F.col("path"))) - 1), "/")).otherwise("")
    grants = borne.filter("path IS NOT NULL").filter(name.rlike(NAMES)).groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("cosine")).alias("far"), "path", "licence")).alias("g"))
    grants = written(grants.select("folder", F.col("g.licence").alias("granted")), "licence-grants")
    bare = files.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct().join(borne.select("path").hint("merge"), "path", "left_anti")
    p = parts(F.col("path"))
    up = F.concat(F.array(F.lit("")), F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>")))
    above = sized_join(bare.select("path", F.posexplode(up).alias("depth", "folder")), grants, "folder", "inner")
    near = above.groupBy("path").agg(F.max(F.struct("depth", "folder", "granted")).alias("n")).select("path", F.col("n.folder").alias("folder"), F.col("n.granted").alias("granted"))
    k, own, got, by = fresh(files, "path_", "own_licence", "licence", "granted_by")
    every = borne.select("path", F.col("licence").alias(own), F.col("licence").alias(got), F.lit(None).cast("string").alias(by))
    every = every.unionByName(near.select("path", F.lit(None).cast("string").alias(own), F.col("granted").alias(got), F.col("folder").alias(by)))
    return files.join(every.withColumnRenamed("path", k).hint("merge"), F.col(path).eqNullSafe(F.col(k)), "left").drop(k)


#: Where the documents lie for the query: by source, language and hundreds of ids; short texts are named as licence files.
LAYOUT = """concat_ws('/', coalesce(source, 'none'), CASE WHEN doc_id % 50 = 0 THEN NULL ELSE coalesce(lang, 'none') END,
  CASE WHEN doc_id % 50 = 0 OR doc_id % 7 = 0 THEN NULL ELSE CAST(floor(doc_id / 100) AS BIGINT) END,
  concat(CASE WHEN length(coalesce(text, '')) < 120 THEN 'LICENSE-' ELSE 'text-' END, CAST(coalesce(doc_id, -1) AS STRING)))"""


def sql(least: float = LEAST) -> str:
    values = ", ".join(f"({i}, '{name}', '{w}', {k})" for i, (name, text) in enumerate(TEMPLATES) for w, k in sorted(template_words(text).items()))
    denials = list(DENIALS)
    layout = LAYOUT.replace("AS STRING", "AS VARCHAR")
    return f"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, {layout} AS path FROM documents),
l AS (SELECT row_number() OVER () AS k, path, list_filter(string_split_regex(lower(line), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words
  FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM f)),
t(i, name, w, tf) AS (VALUES {values}),
ln AS (SELECT * FROM l WHERE len(words) > 0),
tf AS (SELECT k, w, count(*)::DOUBLE AS c FROM (SELECT k, unnest(words) AS w FROM ln) WHERE w IN (SELECT w FROM t) GROUP BY ALL),
idf AS (SELECT v.w, ln((1.0 + (SELECT count(*) FROM ln)) / (1.0 + count(tf.k))) + 1 AS idf FROM (SELECT DISTINCT w FROM t) v LEFT JOIN tf ON tf.w = v.w GROUP BY v.w),
norm AS (SELECT tf.k, sqrt(sum(c * c * idf * idf) + (max(len(words)) - sum(c)) * pow(ln(1.0 + (SELECT count(*) FROM ln)) + 1, 2)) AS norm
  FROM tf JOIN idf USING (w) JOIN ln ON ln.k = tf.k GROUP BY tf.k),
tn AS (SELECT i, sqrt(sum(tf * tf * idf * idf)) AS norm FROM t JOIN idf USING (w) GROUP BY i),
cosine AS (SELECT tf.k, t.name, round(sum(c * idf * t.tf * idf / tn.norm) / max(norm.norm), 6) AS cos FROM tf JOIN idf USING (w) JOIN t USING (w) JOIN tn USING (i) JOIN norm ON norm.k = tf.k JOIN ln ON ln.k = tf.k
  WHERE NOT list_has_any(ln.words, {denials}) OR t.i IN (SELECT i FROM t WHERE list_contains({denials}, w)) GROUP BY tf.k, t.i, t.name),
borne AS (SELECT path, name AS licence, cos FROM (SELECT path, name, cos, row_number() OVER (PARTITION BY path ORDER BY cos DESC, name) AS r FROM cosine JOIN ln USING (k) WHERE cos >= {least}) WHERE r = 1),
grants AS (SELECT folder, licence FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, licence, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cos DESC, path) AS r
  FROM borne WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{NAMES}')) WHERE r = 1),
near AS (SELECT path, folder, licence FROM (SELECT b.path, g.folder, g.licence, row_number() OVER (PARTITION BY b.path ORDER BY length(g.folder) DESC) AS r
  FROM (SELECT path FROM f ANTI JOIN borne USING (path)) b JOIN grants g ON g.folder = '' OR starts_with(b.path, g.folder || '/')) WHERE r = 1)
SELECT f.doc_id, f.path, b.licence AS own_licence, coalesce(b.licence, n.licence) AS licence, n.folder AS granted_by
FROM f LEFT JOIN borne b ON b.path = f.path LEFT JOIN near n ON n.path = f.path
"""
