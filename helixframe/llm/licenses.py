"""License scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along paths.

Marks of comments at line starts are taken off; every line, every paragraph and every sentence of these is a unit. Its terms
weigh by tf * idf over the templates (stop words left out), terms that no template has by the largest idf. A unit matches a
template from a least cosine on. Units without any anchor term can't reach that cosine with any template (see anchors()),
and units with too many other words can't either, so that few are weighed. All of that happens inside the row: only one
licence for each file leaves it. Templates are notices, titles and paragraphs of whole licences. A file's licence is that of
the matched template of highest rank (a clause that one licence has beyond another outranks what both have; a mere "All
rights reserved" counts only by itself), then of the largest cosine, then of the smaller name.

A file's own header wins. A directory has the licence of the licence file in it (by name; of several, the best cosine,
then the smallest path). Other files take that of their nearest ancestor directory that has one.

A null or empty text has no licence of its own and may inherit. A null path is the root's own file with an empty name. Ids
only pass through: null and repeated ones make no difference, and repeated files each get a row. A text of any length is
scanned whole. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.dna import let
from helixframe.llm.common import hot_join, stored

#: Least cosine of a unit to a template; that of a unit of two words. One word is no notice: German has "mit".
LEAST, LEAST_OF_TWO = 0.7, 0.9

#: Identifiers that a one-line tag names.
_SPDX = tuple("Apache-2.0 MIT GPL-3.0 GPL-2.0 LGPL-3.0 LGPL-2.1 AGPL-3.0 BSD-3-Clause BSD-2-Clause ISC MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense".split())

_GNU = "under the terms of the GNU {} as published by the Free Software Foundation; {}"
_LATER = "either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"

#: Common notices, titles and paragraphs by licence identifier, and their rank where it isn't 0.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it " + _GNU.format("General Public License", "version 3 of the License.")),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it " + _GNU.format("General Public License", _LATER.format(3))),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it " + _GNU.format("General Public License", "version 2 of the License.")),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it " + _GNU.format("General Public License", _LATER.format(2))),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is free software licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it " + _GNU.format("Lesser General Public License", _LATER.format(3))),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it " + _GNU.format("Lesser General Public License", _LATER.format(3))),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it " + _GNU.format("Lesser General Public License", _LATER.format("2.1"))),
    ("LGPL-2.1-or-later", "This program is free software; you can redistribute it and/or modify it " + _GNU.format("Lesser General Public License", _LATER.format("2.1"))),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it " + _GNU.format("Affero General Public License", _LATER.format(3))),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 1),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    ("Proprietary", "All rights reserved.", -1),
    *((name, f"SPDX-License-Identifier: {name}") for name in (*_SPDX, *(f"{x}-{end}" for x in _SPDX if "GPL" in x for end in ("only", "or-later")))),
)

#: Marks of comments at the start of a line.
COMMENT = r"^[ \t]*(?:#!.*|#+|//+|/?\*+/?|;+|%+|--+|<!--)[ \t]*"
#: Ends of sentences: what follows the mark, and what stands for it.
SENTENCE, BREAK = r"([.!?])[ \t\n\x0B\f\r]+", "\u0001"

#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

_TERM = r"[a-z0-9]+"

#: Words that are no terms.
STOP = tuple("a all an and any are as at be by can following for from in into is it may met not of on or shall that the this to under use with without you your".split())


def _model(templates) -> tuple[dict[str, float], list[dict[str, float]], float]:
    """idf of the templates' terms, unit vectors of the templates, idf of any other term."""
    docs = [Counter(w for w in re.findall(_TERM, t[1].lower()) if w not in STOP) for t in templates]
    n = len(docs)
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    vectors = []
    for d in docs:
        v = {w: c * idf[w] for w, c in d.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in sorted(v.items())})
    return idf, vectors, math.log(1 + n) + 1


def anchors(templates=TEMPLATES, least: float = LEAST) -> list[str]:
    """Terms of which a unit needs one to reach the least cosine with any template.

    By Cauchy and Schwarz a unit's cosine is at most the norm of the template's vector over the terms they share. Terms
    are taken by falling weight, long ones (rare in prose) first, until what is left of every template is below the least.
    """
    _, vectors, _ = _model(templates)
    chosen: set[str] = set()
    for length in (6, 5, 4, 1):
        while True:
            gain: Counter = Counter()
            for v in vectors:
                rest = {w: x for w, x in v.items() if w not in chosen}
                if math.sqrt(sum(x * x for x in rest.values())) >= least:
                    gain.update({w: x * x for w, x in rest.items() if len(w) >= length})
            if not gain:
                break
            chosen.add(max(gain, key=lambda w: (gain[w], w)))
    return sorted(chosen)


def rank(template: tuple) -> int:
    return template[2] if len(template) > 2 else 0


def own_license(text: Column, templates=TEMPLATES, least: float = LEAST) -> Column:
    """struct(license, score) of the best unit of a text; null without one."""
    idf, vectors, other = _model(templates)
    has = r"(?<![a-z0-9])(" + "|".join(anchors(templates, least)) + r")(?![a-z0-9])"
    # What a known term adds to each template that has it, and to the norm. A literal, folded once.
    of = {w: [(i, v[w] * idf[w]) for i, v in enumerate(vectors) if w in v] for w in idf}
    entry = lambda w: F.struct(F.lit(idf[w]).alias("idf"), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(x).alias("x")) for i, x in of[w]]).alias("on"))
    table = F.create_map(*[x for w in sorted(idf) for x in (F.lit(w), entry(w))])
    names = F.array(*[F.lit(t[0]) for t in templates])
    ranks = F.array(*[F.lit(rank(t)) for t in templates])

    def terms(u: Column) -> Column:
        return F.filter(F.regexp_extract_all(u, F.lit(_TERM), F.lit(0)), lambda x: ~x.isin(*STOP))

    def squares(words: Column) -> Column:
        """Sum of the squares of the words' counts: in order, the k-th of equal words adds 2k - 1."""
        state = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))

        def step(a: Column, w: Column) -> Column:
            k = F.when(a["w"] == w, a["k"] + 1).otherwise(F.lit(1.0))
            return F.struct(w.alias("w"), k.alias("k"), (a["s"] + 2 * k - 1).alias("s"))

        return F.aggregate(F.array_sort(words), state, step, lambda a: a["s"])

    def weighed(known: Column, others: Column) -> Column:
        """Matches of a unit: struct(-rank, -cosine, license), from its known terms and the others."""
        tf = lambda w: F.size(F.filter(known, lambda x: x == w)).cast("double")
        found = F.transform(F.array_distinct(known), lambda w: let(tf(w), lambda n: F.struct(n.alias("n"), F.element_at(table, w).alias("e"))))

        def matched(f: Column) -> Column:
            own = F.aggregate(f, F.lit(0.0), lambda a, x: a + (x["n"] * x["e"]["idf"]) * (x["n"] * x["e"]["idf"]))
            # The cosine is at most the share of the norm that known terms have: with many other words it is out of reach,
            # and their counts needn't be looked at.
            more = F.size(F.array_distinct(others))
            floor, words = more * F.lit(other * other), F.size(f) + more
            bar = F.when(words == 2, F.lit(max(least, LEAST_OF_TWO))).otherwise(F.lit(least))
            near = (words > 1) & (own >= F.lit(least * least * (1 - 1e-9)) * (own + floor))
            norm = F.sqrt(own + F.lit(other * other) * squares(others))
            products = F.flatten(F.transform(f, lambda x: F.transform(x["e"]["on"], lambda p: F.struct(p["t"].alias("t"), (p["x"] * x["n"]).alias("x")))))

            def cosines(ps: Column) -> Column:
                dot = lambda t: F.aggregate(F.filter(ps, lambda p: p["t"] == t), F.lit(0.0), lambda a, p: a + p["x"])
                each = F.array_distinct(F.transform(ps, lambda p: p["t"]))
                return let(norm, lambda z: F.transform(each, lambda t: F.struct((-F.get(ranks, t)).alias("r"), (-F.round(dot(t) / z, 6)).alias("s"), F.get(names, t).alias("license"))))

            return F.when(near, F.filter(let(products, cosines), lambda m: m["s"] <= -bar)).otherwise(F.array().cast("array<struct<r:int,s:double,license:string>>"))

        return let(found, matched)

    def unit(u: Column) -> Column:
        known = lambda w: w.isin(*sorted(idf))
        return let(terms(u), lambda ws: let(F.filter(ws, known), lambda k: let(F.filter(ws, lambda w: ~known(w)), lambda o: weighed(k, o))))

    def units(t: Column) -> Column:
        held = F.filter(F.concat(F.split(t, r"\R"), F.split(t, r"\R\s*\R")), lambda u: u.rlike(has))
        parts = lambda h: F.flatten(F.transform(h, lambda u: F.split(F.regexp_replace(u, SENTENCE, f"$1{BREAK}"), BREAK)))
        return let(held, lambda h: F.array_distinct(F.concat(h, F.filter(parts(h), lambda u: u.rlike(has)))))

    plain = F.lower(F.coalesce(text, F.lit("")))
    best = let(F.regexp_replace(plain, f"(?dm){COMMENT}", ""), lambda t: F.array_min(F.flatten(F.transform(units(t), unit))))
    return F.when(plain.rlike(has), let(best, lambda b: F.when(b.isNotNull(), F.struct(b["license"].alias("license"), (-b["s"]).alias("score")))))


def own_licenses(files: DataFrame, text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """key, license, score: the best unit's licence; files (key, text) without one have no row."""
    return files.select("key", own_license(F.col(text_col), templates, least).alias("own")).where("own is not null").select("key", "own.license", "own.score")


def _directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), "/+$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, the root last."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))
    )


def scan(files: DataFrame, id_col: str, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """id, path, license, score, origin (header, inherited or null), license_dir for every file.

    Only paths and licences are joined, never texts or ids. Directories of very many files or subdirectories are joined by a
    broadcast of their own."""
    path = F.coalesce(files[path_col], F.lit(""))
    slim = files.select(files[id_col].alias("key"), path.alias("path"), _directory(path).alias("dir"), own_license(files[text_col], templates, least).alias("own"))
    paths = stored(slim, "license-own")
    held = paths.where(F.col("own").isNotNull() & F.regexp_extract("path", r"(?s)([^/]*)$", 1).rlike(LICENSE_FILE))
    # One licence for each directory, one row for each directory that a file lies in: the path join is between these.
    of_dir = held.groupBy("dir").agg(F.min(F.struct((-F.col("own.score")).alias("s"), "path", "own.license")).alias("b")).select(F.col("dir").alias("up"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    dirs = stored(paths.groupBy("dir").agg(F.count(F.lit(1)).alias("files")), "license-dirs")
    ups = dirs.select("dir", "files", F.posexplode(_ancestors(F.col("dir"))).alias("far", "up"))
    # With those that hold no licence: an ancestor of very many directories is seen off without gathering them.
    under = ups.groupBy("up").agg(F.count(F.lit(1)).alias("many")).join(of_dir, "up", "left")
    nearest = hot_join(ups, under, "up", "many").where("dir_license is not null").groupBy("dir").agg(F.min(F.struct("far", "up", "dir_license", "dir_score")).alias("n"), F.max("files").alias("files"))
    nearest = nearest.select("dir", "files", F.col("n.up").alias("up"), "n.dir_license", "n.dir_score")
    rows = hot_join(paths, nearest, "dir", "files", "left")
    own = F.col("own.license")
    return rows.select(
        F.col("key").alias(id_col),
        "path",
        F.coalesce(own, "dir_license").alias("license"),
        F.coalesce("own.score", "dir_score").alias("score"),
        F.when(own.isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(own.isNull(), F.col("up")).alias("license_dir"),
    )


def document_path() -> Column:
    """A layout of the documents as files: source/language/hundreds/name, each tenth of a folder's ids a licence file."""
    ident, tail = F.col("doc_id"), F.pmod("doc_id", F.lit(100))
    name = F.when(tail % 10 == 0, F.concat(F.lit("LICENSE-"), tail.cast("string"), F.lit(".txt"))).otherwise(F.concat(ident.cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(ident / F.lit(100)).cast("string"))
    return F.when(F.pmod(ident, F.lit(1000)) == 0, F.concat(F.coalesce("source", F.lit("none")), F.lit("/LICENSE"))).otherwise(F.concat_ws("/", folder, name))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, score, origin, license_dir for every document, laid out by document_path()."""
    return scan(docs.select("doc_id", document_path().alias("path"), "text"), "doc_id")
