"""License scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, each is normalised, and those known from license texts get their
identifier; a sentence that is not known is tried line by line. The identifiers in order, with a blank for each run of other sentences, form a line of
marks. A sentence that says that something is under a license, by any of the license's NAMES, is that license's name
sentence. Rules are ordered identifier sequences; the first rule that matches at a place names the
license, so a whole text wins over its first sentence. Whole texts are read; a document without
any of the CUES, one of which stands in every known sentence, is not cut up.

Cases: a null or empty text and one without a known sentence give no row; nor does an empty table. Each row is a
document, also if it repeats an id or has none. A sentence that occurs twice counts twice. Texts of any length are read
whole. Other columns stay; license_no, license, status and sentences replace columns so called, whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, q, without

# Sentences of public license texts and notices, normalised (lower case, letters,
# digits and single spaces), by identifier.
SENTENCES = {
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit.name": ["released under the mit license", "licensed under the mit license", "mit license", "the mit license", "the mit license mit", "spdx license identifier mit"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.name": ["isc license", "licensed under the isc license", "spdx license identifier isc"],
    "apache.grant": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache.obtain": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache.asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache.name": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "apache license version 2 0", "spdx license identifier apache 2 0"],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd.name": ["licensed under the bsd license", "released under the bsd license"],
    "bsd2.name": ["spdx license identifier bsd 2 clause", "licensed under the bsd 2 clause license"],
    "bsd3.name": ["spdx license identifier bsd 3 clause", "licensed under the bsd 3 clause license"],
    "gpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl.warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.received": ["you should have received a copy of the gnu general public license along with this program"],
    "gpl3.name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"],
    "gpl2.name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later"],
    "lgpl.name": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 3 0 only"],
    "agpl.name": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"],
    "mpl.subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl.name": ["licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "ccby.name": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "ccbysa.name": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync.name": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0.name": ["licensed under cc0 1 0", "spdx license identifier cc0 1 0"],
    "unlicense.free": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
    "apache.title": ["apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004 https www apache org licenses"],
    "apache.license": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "artistic.intent": ["the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications"],
    "artistic.name": ["the artistic license", "spdx license identifier artistic 1 0"],
    "bsd.university": ["neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc.legal": ["creative commons legal code"],
    "cc0.title": ["cc0 1 0 universal"],
    "gfdl13.title": ["gnu free documentation license version 1 3 3 november 2008"],
    "gfdl12.title": ["gnu free documentation license version 1 2 november 2002"],
    "gfdl.purpose": ["the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom to assure everyone the effective freedom to copy and redistribute it with or without modifying it either commercially or noncommercially"],
    "gpl1.title": ["gnu general public license version 1 february 1989"],
    "gpl1.companies": ["the license agreements of most software companies try to keep users at the mercy of those companies"],
    "gpl2.title": ["gnu general public license version 2 june 1991"],
    "gpl3.title": ["gnu general public license version 3 29 june 2007"],
    "gpl3.copyleft": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "gpl.freedom": ["the licenses for most software are designed to take away your freedom to share and change it"],
    "lgpl2.title": ["gnu library general public license version 2 june 1991"],
    "lgpl21.title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl3.title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl3.adds": ["this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"],
    "mpl11.title": ["mozilla public license version 1 1"],
    "mpl11.commercial": ["commercial use means distribution or otherwise making the covered code available to a third party"],
    "mpl2.title": ["mozilla public license version 2 0"],
    "mpl2.contributor": ["contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"],
}

# What licenses are called, by the identifier of their name sentence. A sentence that says that something is
# under one of them counts as that sentence, whatever is under it and however that is put.
NAMES = {
    "mit.name": ["mit license", "mit", "mit licence", "mit expat license"],
    "isc.name": ["isc license"],
    "apache.name": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache license v2"],
    "bsd.name": ["bsd license"],
    "bsd2.name": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "bsd3.name": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "gpl3.name": ["gnu general public license version 3", "gnu general public license version 3 0", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gnu gplv3", "gpl version 3", "gpl v3", "gpl 3 0", "gplv3", "gplv3 license"],
    "gpl2.name": ["gnu general public license version 2", "gnu general public license version 2 0", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gnu gplv2", "gpl version 2", "gpl v2", "gpl 2 0", "gplv2", "gplv2 license"],
    "lgpl.name": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v3", "gnu lgpl v2 1", "lgpl v3", "lgpl v2 1", "lgplv3"],
    "agpl.name": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3"],
    "mpl.name": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0"],
    "ccby.name": ["cc by 4 0", "cc by 4 0 license", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"],
    "ccbysa.name": ["cc by sa 4 0", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"],
    "ccbync.name": ["cc by nc 4 0", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"],
    "cc0.name": ["cc0 1 0", "cc0 1 0 universal license"],
}
UNDER = (
    r"^(?:(?:this|the|our) (?:project|software|program|work|code|source code|file|package|library|repository|module|document|app|application|tool|plugin|data|dataset) is |it is |all (?:source )?code is )?"
    r"(?:released|licensed|distributed|published|provided|available|made available) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
)
UNDER_NAME = UNDER + r"(.*?)(?: the license)?$"

# Ordered rules, the longest first: license, status and the identifiers in order.
RULES = [
    ("Apache-2.0", "text", ("apache.title", "apache.license")),
    ("Artistic-1.0", "text", ("artistic.name", "artistic.intent")),
    ("CC0-1.0", "text", ("cc.legal", "cc0.title")),
    ("GFDL-1.3", "text", ("gfdl13.title", "gfdl.purpose")),
    ("GFDL-1.2", "text", ("gfdl12.title", "gfdl.purpose")),
    ("GPL-1.0", "text", ("gpl1.title", "gpl1.companies")),
    ("GPL-2.0", "text", ("gpl2.title", "gpl.freedom")),
    ("GPL-3.0", "text", ("gpl3.title", "gpl3.copyleft")),
    ("LGPL-2.0", "text", ("lgpl2.title", "gpl.freedom")),
    ("LGPL-2.1", "text", ("lgpl21.title", "gpl.freedom")),
    ("LGPL-3.0", "text", ("lgpl3.title", "lgpl3.adds")),
    ("MPL-1.1", "text", ("mpl11.title", "mpl11.commercial")),
    ("MPL-2.0", "text", ("mpl2.title", "mpl2.contributor")),
    ("BSD-3-Clause", "text", ("reserved", "bsd.grant", "bsd.source", "bsd.binary", "bsd.university")),
    ("BSD-3-Clause", "text", ("reserved", "bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", "text", ("reserved", "bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.university")),
    ("MIT", "text", ("mit.grant", "mit.notice", "mit.asis")),
    ("MIT", "text", ("mit.grant", "mit.notice")),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("Apache-2.0", "notice", ("apache.grant", "apache.obtain", "apache.asis")),
    ("Apache-2.0", "notice", ("apache.grant", "apache.obtain")),
    ("GPL-3.0-or-later", "notice", ("gpl.free", "gpl.warranty", "gpl.received")),
    ("GPL-2.0-or-later", "notice", ("gpl2.free", "gpl.warranty", "gpl.received")),
    ("GPL-3.0-or-later", "notice", ("gpl.free",)),
    ("GPL-2.0-or-later", "notice", ("gpl2.free",)),
    ("ISC", "text", ("isc.grant",)),
    ("MPL-2.0", "notice", ("mpl.subject",)),
    ("Unlicense", "text", ("unlicense.free",)),
    ("MIT", "partial", ("mit.grant",)),
    ("Apache-2.0", "partial", ("apache.grant",)),
    ("BSD", "partial", ("bsd.grant",)),
    ("MIT", "name", ("mit.name",)),
    ("ISC", "name", ("isc.name",)),
    ("Apache-2.0", "name", ("apache.name",)),
    ("BSD-2-Clause", "name", ("bsd2.name",)),
    ("BSD-3-Clause", "name", ("bsd3.name",)),
    ("BSD", "name", ("bsd.name",)),
    ("GPL-3.0", "name", ("gpl3.name",)),
    ("GPL-2.0", "name", ("gpl2.name",)),
    ("LGPL", "name", ("lgpl.name",)),
    ("AGPL-3.0", "name", ("agpl.name",)),
    ("MPL-2.0", "name", ("mpl.name",)),
    ("CC-BY-4.0", "name", ("ccby.name",)),
    ("CC-BY-SA-4.0", "name", ("ccbysa.name",)),
    ("CC-BY-NC-4.0", "name", ("ccbync.name",)),
    ("CC0-1.0", "name", ("cc0.name",)),
    ("Artistic-1.0", "name", ("artistic.name",)),
    ("GPL-1.0", "name", ("gpl1.title",)),
    ("GPL-2.0", "name", ("gpl2.title",)),
    ("GPL-3.0", "name", ("gpl3.title",)),
    ("LGPL-2.1", "name", ("lgpl21.title",)),
    ("LGPL-3.0", "name", ("lgpl3.title",)),
    ("MPL-2.0", "name", ("mpl2.title",)),
    ("proprietary", "name", ("reserved",)),
]
# One of these stands in every known sentence.
CUES = ("creative commons", "cc0 1 0 universal", "covered code", "covered software", "licen", "permission", "copyright", "warrant", "redistribut", "unencumbered", "rights reserved", "endorse or promote",
        "released under", "distributed under", "published under", "provided under", "available under", "available to you under", "released to you under", "distributed to you under", "provided to you under", "published to you under")

SENTENCE_END = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*"
# Layouts of published headers that would cut or join known sentences, and what they are read as: a line of comment
# marks only is blank; the mark of an item of a list starts a paragraph; "v." before a number; the Apache URL in a paragraph of its own. scan_sql knows none of these.
LAYOUTS = [
    (r"(^|\n)[ \t]*(?:\(?[0-9]{1,2}[.)]|\([a-z]\))[ \t]+", "$1\n"),
    (r"\n[ \t\r]*(?:#+|//+|\*+|;+|--+)[ \t\r]*(?=\n)", "\n"),
    (r"(?i)\b(v)\.[^A-Za-z0-9\n]*\n?[^A-Za-z0-9\n]*(?=[0-9])", "$1 "),
    (r"(?i)(a\s+copy\s+of\s+the\s+license\s+at)[^A-Za-z0-9]+https?(://www\.apache\.org/licenses/license-2\.0)(?![A-Za-z0-9]|\.[A-Za-z0-9])[^A-Za-z0-9]*", "$1 http$2. "),
]
CUE_PATTERN = r"(?i)" + "|".join(c.replace(" ", r"[^A-Za-z0-9]+") for c in CUES)
MARK = {name: f"{k:02d}" for k, name in enumerate(SENTENCES)}
RULE_PATTERN = "|".join("(" + "(?: --)?".join(f" {MARK[s]}" for s in ids) + ")" for _, _, ids in RULES)
GAP = " --"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def _known() -> list[tuple[str, str]]:
    """(normalised sentence, mark), and (under <name>, mark) for the licenses' names."""
    out = {s: " " + MARK[name] for name, all_ in NAMES.items() for s in (f"under {x}" for x in all_)}
    return list((out | {s: " " + MARK[name] for name, all_ in SENTENCES.items() for s in all_}).items())


def marks(text: Column) -> Column:
    """The identifiers of a text's sentences in order; runs of other sentences are one blank."""
    known = F.create_map(*(F.lit(x) for pair in _known() for x in pair))
    name = lambda n: F.when(n.rlike(UNDER), F.concat(F.lit("under "), F.regexp_extract(n, UNDER_NAME, 1)))
    of = lambda x: F.coalesce(F.try_element_at(known, normalised(x)), F.try_element_at(known, name(normalised(x))))
    by_line = lambda x: F.array_join(F.transform(F.filter(F.split(x, "\n"), lambda y: normalised(y) != ""), lambda y: F.coalesce(of(y), F.lit(GAP))), "")
    for pattern, plain in LAYOUTS:
        text = F.regexp_replace(text, pattern, plain)
    line = F.array_join(F.transform(F.split(text, SENTENCE_END), lambda x: F.coalesce(of(x), by_line(x))), "")
    return F.regexp_replace(line, f"({GAP})+", GAP)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without text_col, a row for each license found, in order: license_no (from 0), license,
    status (text, notice, partial or name) and sentences (how many of the rule's were there)."""
    text = q(text_col)
    one, line, found_, rule_ = (fresh(x, docs) for x in ("one", "marks", "found", "rule"))
    kept = without(docs, text_col, "license_no", "license", "status", "sentences").columns
    hit = docs.filter(text.rlike(CUE_PATTERN)).select(*(q(c) for c in kept), F.explode(F.split(F.lit("0"), ",")).alias(one), marks(text).alias(line)).drop(one)
    found = F.regexp_extract_all(q(line), F.lit(f"({RULE_PATTERN})"), F.lit(1))
    rows = hit.select(*(q(c) for c in kept), F.posexplode(found).alias("license_no", found_))
    by = {}
    for license_, status, ids in RULES:
        by.setdefault("".join(f" {MARK[s]}" for s in ids), (license_, status, len(ids)))
    rule = F.create_map(*(x for k, v in by.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("license"), F.lit(v[1]).alias("status"), F.lit(v[2]).alias("sentences")))))
    rows = rows.withColumn(rule_, rule[F.replace(q(found_), F.lit(GAP), F.lit(""))])
    return rows.select(*(q(c) for c in kept), "license_no", f"{rule_}.license", f"{rule_}.status", f"{rule_}.sentences")


def scan_sql() -> str:
    """DuckDB SQL of scan(documents), but for texts with LAYOUTS."""
    known = ", ".join(f"('{s}', '{mark}')" for s, mark in _known())
    key = lambda n: f"CASE WHEN {n} NOT IN (SELECT sentence FROM known) AND regexp_matches({n}, '{UNDER}') THEN 'under ' || regexp_extract({n}, '{UNDER_NAME}', 1) ELSE {n} END"
    by = {}
    for license_, status, ids in RULES:
        by.setdefault("".join(f" {MARK[s]}" for s in ids), (license_, status, len(ids)))
    rules = ", ".join(f"('{k}', '{a}', '{b}', {n})" for k, (a, b, n) in by.items())
    norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, mark) AS (VALUES {known}), rules(marks, license, status, sentences) AS (VALUES {rules}),
parts AS (SELECT row_number() OVER () AS doc, doc_id, string_split_regex(text, '{SENTENCE_END}') AS p FROM documents),
cut AS (SELECT doc, doc_id, unnest(p) AS s, unnest(range(len(p))) AS place FROM parts),
sentences AS (SELECT doc, doc_id, place, s, {key(norm.format('s'))} AS n FROM cut),
tried AS (SELECT doc, doc_id, place, unnest(string_split(s, chr(10))) AS y, unnest(range(len(string_split(s, chr(10))))) AS sub FROM sentences WHERE n NOT IN (SELECT sentence FROM known)),
clean AS (
  SELECT doc, doc_id, place, 0 AS sub, mark FROM sentences JOIN known ON n = sentence
  UNION ALL SELECT doc, doc_id, place, sub, coalesce(mark, '{GAP}') FROM tried LEFT JOIN known ON {key(norm.format('y'))} = sentence WHERE {norm.format('y')} <> ''
),
lines AS (
  SELECT doc, doc_id, regexp_replace(string_agg(mark, '' ORDER BY place, sub), '({GAP})+', '{GAP}', 'g') AS marks FROM clean GROUP BY doc, doc_id
), found AS (SELECT doc_id, regexp_extract_all(marks, '{RULE_PATTERN}') AS f FROM lines),
hits AS (SELECT doc_id, unnest(f) AS m, unnest(range(len(f))) AS license_no FROM found)
SELECT doc_id, license_no::INT AS license_no, license, status, sentences
FROM hits JOIN rules ON replace(m, '{GAP}', '') = rules.marks
"""
