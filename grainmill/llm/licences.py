"""Licence scans: sparse TF-IDF cosine of sentences to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh

# Short forms by which works name their licence, as identifier and sentence.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is free software licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright, CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _standard_texts() -> tuple[tuple[str, str, bool], ...]:
    """The headers that licences prescribe and the heads of their texts, for each version and variant, and whether it is a mere title."""
    gnu = {"GPL-2.0": ("General", "2", "June 1991", "1989, 1991"), "GPL-3.0": ("General", "3", "29 June 2007", "2007"), "LGPL-2.1": ("Lesser General", "2.1", "February 1999", "1991, 1999"),
           "LGPL-3.0": ("Lesser General", "3", "29 June 2007", "2007"), "AGPL-3.0": ("Affero General", "3", "19 November 2007", "2007")}
    body = {"GPL-2.0": "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
            "GPL-3.0": "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works",
            "LGPL-2.1": "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1. Preamble The licenses for most software are designed to take away your freedom",
            "LGPL-3.0": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional Definitions.",
            "AGPL-3.0": "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"}
    out, titles = [], {"Mozilla Public License Version 2.0"}
    for name, (kind, version, date, years) in gnu.items():
        title = f"GNU {kind} Public License Version {version}, {date}"
        titles.add(title)
        rights = f"Copyright (C) {years} Free Software Foundation, Inc."
        copies = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
        out += [(name, title), (name, f"{title} {rights} {copies} {body[name]}"), (name, f"{title} {rights} 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {copies} {body[name]}")]
        what = "library" if name == "LGPL-2.1" else "program"
        for later in (f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License", f"version {version} as published by the Free Software Foundation"):
            grant = (f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; {later}. This {what} is distributed in the hope that it will be useful,"
                     f" but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this {what};")
            out += [(name, f"{grant} if not, see https://www.gnu.org/licenses/"), (name, f"{grant} if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")]
    apache = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"
    titles.add(apache)
    out += [("Apache-2.0", apache), ("Apache-2.0", f"{apache} TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
            ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
             " software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")]
    out += [("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
            ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")]
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
           " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    fourth = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4." + third[3:]
    end = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
    out += [("BSD-2-Clause", bsd + end), ("BSD-3-Clause", bsd + third + end), ("BSD-4-Clause", bsd + fourth + end)]
    out += [("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,"
             " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
            ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")]
    for name, kind in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        out += [(f"CC-{name}-4.0", f"This work is licensed under a Creative Commons {kind} 4.0 International License"), (f"CC-{name}-4.0", f"Creative Commons {kind} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {kind} 4.0 International Public License")]
    out += [("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.")]
    return tuple((licence, text, text in titles) for licence, text in out)


STANDARD = _standard_texts()
#: Titles count only at the head of a file, after so many other terms at most.
HEAD_TERMS = 8
#: Neighbouring terms at which standard texts and files are laid side by side.
ANCHORS = (("public", "license"), ("apache", "license"), ("creative", "commons"), ("binary", "forms"), ("hereby", "granted"), ("free", "unencumbered"))
# Words that weigh nothing.
STOP_WORDS = ("a", "all", "and", "any", "are", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "this", "to", "was", "with")
THRESHOLD = 0.6
_SENTENCE, _TOKEN = r"[.!?;]\s+|\n", r"[^a-z0-9.]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.\-][^/]*)?$"


def tokens(text: Column) -> Column:
    """Lower-case terms of a sentence without stop words and without full stops at their ends."""
    terms = F.transform(F.split(F.lower(text), _TOKEN), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.filter(terms, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def _known() -> list[str]:
    """The terms of the short forms."""
    return sorted({t for _, sentence in TEMPLATES for t in _terms(sentence)})


def read_terms(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(row, path, sentences, spots): one pass over the texts that keeps only what can name a licence.

    ``sentences`` holds the terms of those sentences that have a term of the short forms, ``spots`` the terms around the places
    where a standard text may lie. Rows are numbered, so that repeated paths stay apart; the result is in the checkpoint folder.
    """
    known = _known()
    any_term = "|".join(t.replace(".", r"\.") for t in known)
    text = F.col("text")
    likely = text.rlike(rf"(?i)(?<![a-z0-9])({any_term})(?![a-z0-9])")
    each = F.transform(F.split(text, _SENTENCE), lambda s, i: F.struct(i.alias("at"), tokens(s).alias("terms")))
    sentences = F.when(likely, F.filter(each, lambda s: F.arrays_overlap(s["terms"], F.array(*map(F.lit, known)))))
    placed = text.rlike("(?i)" + "|".join(rf"{a}[^a-z0-9]+(?:and[^a-z0-9]+)?{b}" for a, b in ANCHORS))
    source = files.select(F.monotonically_increasing_id().alias("row"), files[path_col].alias("path"), files[text_col].alias("text"))
    return cut_lineage(source.select("row", "path", sentences.alias("sentences"), F.when(placed, _spots(tokens(text))).alias("spots")))


def detect(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, licence, score) of each file of ``read_terms`` with a sentence whose cosine to a template reaches ``threshold``.

    Sentences end at newlines and at full stops and the like before white space. Terms of templates weigh by their inverse
    frequency over all files; other terms weigh as ones in no file. Sentences without a template's term have cosine 0 and
    take no further part. Of equal cosines the licence first in alphabetical order holds. Null and empty texts name none.
    """
    spark, known = files.sparkSession, _known()
    total = files.count()
    own = F.array_intersect(F.array_distinct(F.flatten(F.transform("sentences", lambda s: s["terms"]))), F.array(*map(F.lit, known)))
    seen = {r["term"]: r["n"] for r in files.select(F.explode(own).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # terms of a fixed table
    idf = {t: math.log((total + 1) / (seen.get(t, 0) + 1)) + 1 for t in known}
    unseen = math.log(total + 1) + 1
    vectors = []
    for i, (licence, sentence) in enumerate(TEMPLATES):
        weights = {t: n * idf[t] for t, n in Counter(_terms(sentence)).items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        vectors += [(i, licence, t, w / size) for t, w in sorted(weights.items())]
    shares = F.broadcast(spark.createDataFrame(vectors, "template int, licence string, term string, share double"))
    scale = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    counted = files.select("row", F.explode("sentences").alias("s")).select("row", "s.at", F.explode("s.terms").alias("term")).groupBy("row", "at", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = counted.join(scale, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    whole = counted.groupBy("row", "at").agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("terms"))  # each known term once
    dots = whole.select("row", "at", "square", F.explode("terms").alias("t")).select("row", "at", "square", "t.term", "t.w").join(shares, "term").groupBy("row", "at", "square", "template", "licence").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.select("row", "licence", F.round(F.col("dot") / F.sqrt("square"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("b"))
    return best.select("row", F.col("b.licence").alias("licence"), (-F.col("b.low")).alias("score"))


def _terms(text: str) -> list[str]:
    """As ``tokens``, of a fixed text."""
    terms = (t.strip(".") for t in re.split(_TOKEN, text.lower()))
    return [t for t in terms if t and t not in STOP_WORDS]


def _standard() -> tuple[list[tuple], list[tuple], dict[str, float], int, int]:
    """Of the standard texts: rows, weighed terms, inverse frequencies, the most terms before an anchor, and in a text."""
    texts = [(licence, _terms(text), title) for licence, text, title in STANDARD]
    often = Counter(t for _, terms, _ in texts for t in set(terms))
    idf = {t: math.log((len(texts) + 1) / (n + 1)) + 1 for t, n in often.items()}
    rows, vectors = [], []
    for i, (licence, terms, title) in enumerate(texts):
        spots = [(k, ANCHORS.index(a)) for k, a in enumerate(zip(terms, terms[1:], strict=False)) if a in ANCHORS]
        rows.append((i, licence, spots[0][1], spots[0][0], len(terms), title, sorted(set(terms))))
        weights = {t: n * idf[t] for t, n in Counter(terms).items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        vectors += [(i, t, w / size) for t, w in weights.items()]
    return rows, vectors, idf, max(r[3] for r in rows), max(r[4] for r in rows)


def _spots(terms: Column) -> Column:
    """Where two terms are an anchor: which, where, where the terms near it begin, and these."""
    *_, before, longest = _standard()
    pair = lambda x, y: reduce(lambda rest, a: F.when((x == a[1][0]) & (y == a[1][1]), F.lit(a[0])).otherwise(rest), enumerate(ANCHORS), F.lit(-1))
    first = lambda i: F.greatest(i - before, F.lit(0))

    def found(terms: Column) -> Column:
        kinds = F.zip_with(terms, F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), pair)
        spots = F.filter(F.transform(kinds, lambda a, i: F.struct(a.alias("anchor"), i.alias("i"))), lambda x: x["anchor"] >= 0)
        return F.transform(spots, lambda x: F.struct(x["anchor"].alias("anchor"), x["i"].alias("i"), first(x["i"]).alias("from"), F.slice(terms, first(x["i"]) + 1, F.lit(before + longest)).alias("near")))

    return F.transform(F.array(terms), found)[0]  # the terms are computed once


def detect_standard(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, licence, score) of each file of ``read_terms`` that holds a standard header or licence head, over line breaks and
    comment signs.

    A window as long as the standard text is laid over the file wherever the two have the same anchor, anywhere in the
    file; both weigh their terms by inverse frequency over the standard texts. Only windows with a third of the text's
    different terms are weighed. Of equal cosines the longer text holds, then the licence first in alphabetical order.
    """
    spark = files.sparkSession
    rows, vectors, idf, before, longest = _standard()
    unseen = F.lit(math.log(len(rows) + 1) + 1)
    standard = spark.createDataFrame(rows, "template int, licence string, anchor int, ahead int, n int, title boolean, own array<string>")
    placed = files.select("row", F.explode("spots").alias("a")).select("row", "a.*").join(F.broadcast(standard), "anchor")
    start = F.greatest(F.col("i") - F.col("ahead"), F.lit(0))
    placed = placed.where(~F.col("title") | (start <= HEAD_TERMS))
    windows = placed.select("row", F.col("i").alias("at"), "template", "licence", "n", "own", F.slice("near", start - F.col("from") + 1, F.col("n")).alias("window"))
    windows = windows.where(3 * F.size(F.array_intersect("window", "own")) >= F.size("own"))
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    shares = F.broadcast(spark.createDataFrame(vectors, "template int, term string, share double"))
    counted = windows.select("row", "at", "template", "licence", "n", F.explode("window").alias("term")).groupBy("row", "at", "template", "licence", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = counted.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen)).join(shares, ["template", "term"], "left")
    scored = counted.groupBy("row", "at", "template", "licence", "n").agg(F.round(F.sum(F.col("w") * F.coalesce("share", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("low"), (-F.col("n")).alias("short"), "licence")).alias("b"))
    return best.select("row", F.col("b.licence").alias("licence"), (-F.col("b.low")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path; the empty string for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The licence of every file: its own, or that of a licence file in the nearest ancestor directory.

    A standard header or licence text names a file's own licence before any sentence of it does.
    Returns path, own_licence, own_score, licence and licence_dir (null unless inherited). Ancestors are looked up once for
    each directory, not for each file. Of several licence files of a directory the least path holds, of equal paths the licence
    first in alphabetical order. Files without path are left out; each row is judged by its own text, also where paths repeat; null
    and empty texts name nothing; texts count whole, however long. An empty table gives an empty result; further columns are not
    passed on, whatever their names.
    """
    held = read_terms(files.where(files[path_col].isNotNull()), path_col, text_col)
    short = detect(held, threshold)
    standard = detect_standard(held, threshold).select("row", F.col("licence").alias("_licence"), F.col("score").alias("_score"))
    agree = F.col("_licence").isNull() | F.col("licence").eqNullSafe(F.col("_licence"))  # then the short form's score holds
    found = short.join(standard, "row", "full").select("row", F.when(agree, F.col("licence")).otherwise(F.col("_licence")).alias("licence"), F.when(agree, F.col("score")).otherwise(F.col("_score")).alias("score"))
    own = cut_lineage(held.select("row", "path").join(found, "row", "left").withColumn("dir", parent(F.col("path"))))
    licensed = own.where(F.col("path").rlike(LICENCE_FILE) & F.col("licence").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "licence"))["licence"].alias("dir_licence"))
    licensed = cut_lineage(licensed).select(fresh("dir").alias("ancestor"), "dir_licence")
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    climbed = own.select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "ancestor"))
    near = climbed.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_licence")).alias("n"))
    near = cut_lineage(near).select(fresh("dir").alias("_dir"), "n.ancestor", "n.dir_licence")
    joined = own.join(near, F.col("dir") == F.col("_dir"), "left")
    inherits = F.col("licence").isNull()
    return joined.select("path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "dir_licence").alias("licence"), F.when(inherits, F.col("ancestor")).alias("licence_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source / hundreds of ids / tens / file. Ids that end in 0 are the LICENSE files of the
    directory of tens, those that end in 00 of the directory of hundreds."""
    k = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("h"), F.floor(k / 100)))
    tens = F.concat_ws("/", top, F.concat(F.lit("t"), F.floor(k / 10)))
    path = F.when(k % 100 == 0, F.concat(top, F.lit("/LICENSE"))).when(k % 10 == 0, F.concat(tens, F.lit("/LICENSE"))).otherwise(F.concat(tens, F.lit("/"), k.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
    stop = ", ".join(map(quoted, STOP_WORDS))
    terms = lambda c: f"list_filter(list_transform(string_split_regex(lower({c}), '[^a-z0-9.]+'), lambda t: regexp_replace(t, '^\\.+|\\.+$', '', 'g')), lambda t: t <> '' AND t NOT IN ({stop}))"
    return f"""
WITH RECURSIVE template AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest({terms('sentence')}) AS term FROM (VALUES {rows}) v(template, licence, sentence)) GROUP BY ALL),
term AS (SELECT DISTINCT term FROM template),
known AS (SELECT list(term) AS known FROM term),
top AS (SELECT doc_id, text, coalesce(source, 'none') || '/h' || (doc_id // 100) AS top FROM documents),
file AS (SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN top || '/LICENSE' WHEN doc_id % 10 = 0 THEN top || '/t' || (doc_id // 10) || '/LICENSE' ELSE top || '/t' || (doc_id // 10) || '/' || doc_id || '.txt' END AS path FROM top),
total AS (SELECT count(*) AS files FROM file WHERE path IS NOT NULL),
sentence AS (SELECT path, pos, {terms('sentence')} AS terms FROM (SELECT path, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT path, string_split_regex(text, '[.!?;]\\s+|\\n') AS s FROM file WHERE path IS NOT NULL))),
hit AS (SELECT path, pos, terms FROM sentence, known WHERE list_has_any(terms, known)),
word AS (SELECT path, pos, term, count(*) AS tf FROM (SELECT path, pos, unnest(terms) AS term FROM hit) GROUP BY ALL),
seen AS (SELECT term, count(DISTINCT path) AS df FROM word SEMI JOIN term USING (term) GROUP BY term),
idf AS (SELECT term, ln((files + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM term LEFT JOIN seen USING (term), total),
vector AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS share FROM (SELECT template, licence, term, tf * idf AS w FROM template JOIN idf USING (term))),
weighed AS (SELECT path, pos, term, tf * coalesce(idf, ln(files + 1) + 1) AS w FROM word LEFT JOIN idf USING (term), total),
square AS (SELECT path, pos, sum(w * w) AS square FROM weighed GROUP BY ALL),
scored AS (SELECT path, licence, round(sum(w * share) / sqrt(any_value(square)), 6) AS score FROM weighed JOIN vector USING (term) JOIN square USING (path, pos) GROUP BY path, pos, template, licence),
own_found AS (SELECT path, licence, score FROM scored WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1),
own AS (SELECT doc_id, file.path, licence, score, regexp_replace(file.path, '/?[^/]*$', '') AS dir FROM file LEFT JOIN own_found USING (path) WHERE file.path IS NOT NULL),
licensed AS (SELECT dir, arg_min(licence, path) AS dir_licence FROM own WHERE regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$') AND licence IS NOT NULL GROUP BY dir),
climb(dir, ancestor) AS (SELECT DISTINCT dir, dir FROM own UNION SELECT dir, regexp_replace(ancestor, '/?[^/]*$', '') FROM climb WHERE ancestor <> ''),
near AS (SELECT climb.dir, arg_max(ancestor, length(ancestor)) AS ancestor, arg_max(dir_licence, length(ancestor)) AS dir_licence FROM climb JOIN licensed ON licensed.dir = climb.ancestor GROUP BY climb.dir)
SELECT path, licence AS own_licence, score AS own_score, coalesce(licence, dir_licence) AS licence, CASE WHEN licence IS NULL THEN ancestor END AS licence_dir FROM own LEFT JOIN near USING (dir)"""


ORACLE = _oracle()
