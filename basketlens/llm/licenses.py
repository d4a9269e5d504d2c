"""License scans by sentence rules, in DataFrame functions only.

A text is split into sentences and each sentence that spans lines into its
lines as well.  A sentence ends at ``. ! ?`` before white space, at a line
without letters and digits (empty, or comment marks only), before and after a
copyright line, at a URL, between the parts of an SPDX expression (four at
most), and at a colon before a numbered item; comment marks that are words
(``dnl``, ``REM``) go first.  No known sentence holds one of these ends, so
they lose none.  A sentence is normalised to lower-case ASCII words, parts that
vary (the holder's or the project's name, how a notice begins, where the text of
the licence stands) take their usual form, and its place in the list of known
sentences is its identifier.  The identifiers of a text, in order, are matched
against the rules, longest rule first; an identifier used by one rule is not
used by another.

Known are the sentences of licence texts (``TEXTS``), and by rule: notices that
name a licence (``NAMES``; GNU and Creative Commons licences by family and
version) and SPDX identifiers (``SPDX``).

Everything happens inside a row: no join, no shuffle, no Python.  Only texts
with one of the ``ANCHORS`` are split; each known sentence has one, so none is
lost (a test holds the list to that).

Nulls: a null or empty text has no licences; a null doc_id stays.  Repeated
rows are scanned each.  Ties: rules of one length are tried as listed.  An empty
table gives no rows.  Extra columns and names that differ in case only are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import pick

# Sentences of public licence texts, normalised, by a name of
# their own; names with the same prefix belong together.
TEXTS: dict[str, str] = {
    "apache2-terms": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-permitted": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license version 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc0-waiver": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
}

# Licence and the sentences of its text that state it, in their order.
TEXT_RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2-terms", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-terms",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-permitted", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("0BSD", ("0bsd-grant", "mit-warranty")),
    ("0BSD", ("0bsd-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
]

# Names of licences in notices ("licensed under the ..."), normalised.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit", "expat license", "mit x11 license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache 2 0", "apache software license version 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license", "zlib libpng license"),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
    "CC0-1.0": ("cc0 1 0 license", "cc0 1 0 universal license", "creative commons zero v1 0 universal license"),
}

# GNU licences as (SPDX name, words before "general public license", versions), Creative Commons by attribute.
GNU = (("GPL", "", ("2.0", "3.0")), ("LGPL", "lesser ", ("2.0", "2.1", "3.0")), ("AGPL", "affero ", ("3.0",)))
CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-NC-SA": "attribution noncommercial sharealike", "BY-ND": "attribution noderivatives", "BY-NC-ND": "attribution noncommercial noderivatives"}
CC_ENDS = {"3.0": "unported", "4.0": "international"}

# Identifiers of the SPDX list; those of GNU and Creative Commons come by rule.
SPDX = (
    "MIT MIT-0 X11 ISC 0BSD Zlib Unlicense WTFPL NCSA PostgreSQL BSL-1.0 UPL-1.0 OFL-1.1 EUPL-1.2 CC0-1.0 MS-PL MS-RL "
    "Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 Artistic-1.0 Artistic-2.0"
).split()


def _words(name: str) -> str:
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in name).split())


def _by_rule() -> Iterator[tuple[str, str, str]]:
    """(name, sentence, licence) of notices and SPDX identifiers, each a rule of its own."""
    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            yield f"notice-{licence}-{i}", f"licensed under the {name}", licence
    for family, words, versions in GNU:
        for version in versions:
            forms = {_words(version), _words(version.removesuffix(".0"))}
            later = {"": "only", " only": "only", " or later": "or-later", " or any later version": "or-later", " or at your option any later version": "or-later"}
            for i, (form, end) in enumerate((f, e) for f in sorted(forms) for e in later):
                licence = f"{family}-{version}-{later[end]}"
                yield f"notice-{family}-{version}-{i}", f"licensed under the gnu {words}general public license version {form}{end}", licence
                yield f"notice-{family}-{version}-short-{i}", f"licensed under the {family.lower()} {form}{end}", licence
            for i, form in enumerate(sorted(forms)):
                terms = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
                yield f"{family.lower()}{version}-only-{i}", f"{terms.format(words)} version {form} as published by the free software foundation", f"{family}-{version}-only"
            for end in ("only", "or-later"):
                yield f"spdx-{family}-{version}-{end}", f"spdx license identifier {_words(f'{family}-{version}-{end}')}", f"{family}-{version}-{end}"
            yield f"spdx-{family}-{version}", f"spdx license identifier {_words(f'{family}-{version}')}", f"{family}-{version}-only"
    for short, long in CC.items():
        for version, end in CC_ENDS.items():
            licence, number = f"CC-{short}-{version}", _words(version)
            yield f"notice-{licence}", f"licensed under the {_words(licence)}", licence
            yield f"notice-{licence}-license", f"licensed under the {_words(licence)} license", licence
            yield f"notice-{licence}-long", f"licensed under the creative commons {long} {number} {end} license", licence
            yield f"spdx-{licence}", f"spdx license identifier {_words(licence)}", licence
    for licence in SPDX:
        yield f"spdx-{licence}", f"spdx license identifier {_words(licence)}", licence


def _gnu_texts() -> Iterator[tuple[str, str, str | None]]:
    """(name, sentence, licence that it states) of the header of GNU licences."""
    for family, words, versions in GNU:
        for version in versions:
            form = _words(version.removesuffix(".0"))
            terms = f"this program is free software you can redistribute it and or modify it under the terms of the gnu {words}general public license as published by the free software foundation"
            yield f"{family.lower()}{version.removesuffix('.0')}-terms", f"{terms} either version {form} of the license or at your option any later version", f"{family}-{version}-or-later"
        yield f"{family.lower()}-see", f"see the gnu {words}general public license for more details", None


SENTENCES: dict[str, str] = {**TEXTS, **{n: s for n, s, _ in _gnu_texts()}, **{n: s for n, s, _ in _by_rule()}}
RULES: list[tuple[str, tuple[str, ...]]] = [
    *TEXT_RULES,
    *((licence, (name, "gpl-hope", f"{name.rstrip('0123456789.').split('-')[0].rstrip('0123456789.')}-see")) for name, _, licence in _gnu_texts() if licence),
    *((licence, (name,)) for name, _, licence in _gnu_texts() if licence),
    *((licence, (name,)) for name, _, licence in _by_rule()),
]

# Each known sentence holds one of these (lower case), in the text too.
ANCHORS = ("licen", "permi", "copyright", "warrant", "redistribut", "liable", "free software", "unencumbered", "gpl", "cc by", "cc-by", "cc0", "mpl", "under the mit", "apache 2", "under mit", "under apache")

# What follows is written so that Java's and RE2's expressions mean the same:
# @ stands for the ASCII punctuation inside a set, \x01 hides a word.
# Ends of sentences: flags, pattern and what takes its place, in order.
_OPERATOR = ("", r"(SPDX-License-Identifier:[^\r\n]*?)[ \t)]+(?:OR|AND|WITH)[ \t(]+", "$1\n\nSPDX-License-Identifier: ")
ENDS: list[tuple[str, str, str]] = [
    ("m", r"^[ \t]*(?:dnl|REM)(?:[ \t]+|\r?$)", ""),
    ("i", r"(?:https?|ftp)://[^ \t\r\n\f]+", "\n\n"),
    *[_OPERATOR] * 3,
    ("", r"(SPDX-License-Identifier:[^\r\n]*[0-9])\+", "$1-or-later"),
    ("", r"([ \t\r\n,(][vV])\.[ \t\r\n]+([0-9])", "$1 $2"),  # "v. 2.0" is no end
    ("", r"([.!?])[ \t\r\n]+", "$1\n\n"),
    # a wrapped line that begins with "copyright notice" or "copyright holders" is no copyright line
    ("im", r"^([ \t@]*)copyright([a-z]|[ \t]*\r?$|[ \t]+notice|[ \t]+holder)", "$1copy\x01right$2"),
    ("im", r"^([ \t@]*(?:copyright|\(c\)[ \t]*[0-9]{4}|\x{a9}|spdx-filecopyrighttext|all rights reserved)[^\r\n]*)", "\n\n$1\n\n"),
    ("", "\x01", ""),
    ("", r":[ \t\r]*\n([ \t@]*[0-9]{1,2}[.)][ \t\r\n\f])", ":\n\n$1"),
    ("m", r"^[ \t]*[@]+[ \t\r]*$", ""),
]
# Parts of normalised sentences that vary, and their usual form, in order.
VARIABLE: list[tuple[str, str]] = [
    (r"^(?:[0-9a-z] )?neither the names? of .{1,200} (?:nor|or) the names? of (?:its|their|the|any) contributors? may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^(?:[a-z0-9 ]{1,60} )?is free software you can redistribute it", "this program is free software you can redistribute it"),
    (r"^(?:this|the) [a-z0-9 ]{1,60} is distributed in the hope", "this program is distributed in the hope"),
    (
        r"^(?:(?:this|the) (?:software|project|source code|code|file|work|program|library|package|module|repository|document) is )?"
        r"(?:released|licensed|licenced|distributed|made available|available|provided|published) under (?:the )?(?:terms of )?(?:the |an? )?",
        "licensed under the ",
    ),
    (r" public licen[sc]e (?:version |v ?)?([0-9])", " public license version $1"),
    (r"^licensed under the (?:gnu )?([al]?)gpl(?: license)?(?: version| v|v)? ?([0-9])", "licensed under the $1gpl $2"),
    (r"(.) (?:please )?see (?:the )?(?:accompanying |included )?(?:file )?(?:license|licence|copying)(?: file| txt| md)*(?: for (?:more |further |full )?(?:details|information|terms))?$", "$1"),
]


def _java(flags: str, pattern: str) -> str:
    # d: only \n ends a line
    return (f"(?d{flags})" if flags else "") + pattern.replace("@", r"\p{Punct}")


def _re2(flags: str, pattern: str) -> str:
    return (f"(?{flags})" if flags else "") + pattern.replace("@", "[:punct:]")


def ordered_rules() -> list[tuple[str, str]]:
    """(licence, identifiers as text) of the rules, longest first, as listed among equals."""
    number = {name: i for i, name in enumerate(SENTENCES, 1)}
    rules = sorted(RULES, key=lambda rule: -len(rule[1]))
    return [(licence, "".join(f",{number[s]}," for s in names)) for licence, names in rules]


def normalised(column: F.Column) -> F.Column:
    """Lower-case ASCII words of a sentence, variable parts in their usual form."""
    words = F.trim(F.lower(F.regexp_replace(column, "[^A-Za-z0-9]+", " ")))
    for pattern, usual in VARIABLE:
        words = F.regexp_replace(words, F.lit(pattern), F.lit(usual))
    return words


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentence_ids, n_sentences, n_unruled) of each document.

    ``licenses``: distinct licences in name order, joined by commas;
    ``sentence_ids``: names of the known sentences in order, joined by commas;
    ``n_sentences``: how many; ``n_unruled``: those that no rule used.
    """
    known = F.array(*(F.lit(s) for s in SENTENCES.values()))
    names = F.array(*(F.lit(s) for s in SENTENCES))
    text = F.col("text")
    lower = F.lower(text)
    worth = F.lit(False)
    for anchor in ANCHORS:
        worth = worth | lower.contains(anchor)
    marked = text
    for flags, pattern, instead in ENDS:
        marked = F.regexp_replace(marked, F.lit(_java(flags, pattern)), F.lit(instead))
    sentences = F.split(marked, r"\n[ \t\r]*\n")
    # a sentence over several lines, then each of its lines
    units = F.flatten(F.transform(sentences, lambda s: F.when(s.contains("\n"), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))
    found = F.filter(F.transform(units, lambda u: F.array_position(known, normalised(u))), lambda i: i > 0)
    docs = pick(documents, "doc_id", "text")
    docs = docs.select("doc_id", F.when(worth, found).alias("ids"))
    left = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))))
    for licence, ids in ordered_rules():
        left = F.replace(left, F.lit(ids), F.lit(f"<{licence}>"))
    docs = docs.select("doc_id", "ids", left.alias("left"))
    used = F.regexp_extract_all("left", F.lit("<([^>]+)>"), F.lit(1))
    return docs.select(
        "doc_id",
        F.concat_ws(",", F.array_sort(F.array_distinct(used))).alias("licenses"),
        F.concat_ws(",", F.transform("ids", lambda i: F.element_at(names, i.cast("int")))).alias("sentence_ids"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_sentences"),
        F.size(F.regexp_extract_all("left", F.lit(",([0-9]+),"), F.lit(1))).cast("long").alias("n_unruled"),
    )


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` over the view ``documents``: sentences as rows, rules as folded replacements."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    group = lambda s: s.replace("$", "\\")
    known = ", ".join(f"({i}, {quote(n)}, {quote(s)})" for i, (n, s) in enumerate(SENTENCES.items(), 1))
    marked = "text"
    for flags, pattern, instead in ENDS:
        marked = f"regexp_replace({marked}, {quote(_re2(flags, pattern))}, {quote(group(instead))}, 'g')"
    words = "trim(lower(regexp_replace(u, '[^A-Za-z0-9]+', ' ', 'g')))"
    for pattern, usual in VARIABLE:
        words = f"regexp_replace({words}, {quote(pattern)}, {quote(group(usual))}, 'g')"
    left = "coalesce(k.ids, '')"
    for licence, ids in ordered_rules():
        left = f"replace({left}, '{ids}', '<{licence}>')"
    worth = " OR ".join(f"contains(lower(text), {quote(a)})" for a in ANCHORS)
    return rf"""
WITH known(id, name, sentence) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
sentences AS (
  SELECT r, unnest(list) AS s, generate_subscripts(list, 1) AS i
  FROM (SELECT r, regexp_split_to_array({marked}, '\n[ \t\r]*\n') AS list FROM docs WHERE {worth})
),
units AS (
  SELECT r, i, 0 AS j, s AS u FROM sentences
  UNION ALL
  SELECT r, i, generate_subscripts(string_split(s, chr(10)), 1) AS j, unnest(string_split(s, chr(10))) AS u FROM sentences WHERE contains(s, chr(10))
),
hits AS (
  SELECT r, i, j, id, name FROM units JOIN known ON {words} = sentence
),
per_doc AS (
  SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY i, j) AS names, string_agg(',' || id || ',', '' ORDER BY i, j) AS ids FROM hits GROUP BY r
),
ruled AS (
  SELECT d.doc_id, coalesce(k.names, '') AS sentence_ids, coalesce(k.n, 0) AS n_sentences, {left} AS left_over
  FROM docs d LEFT JOIN per_doc k ON k.r = d.r
)
SELECT doc_id,
  array_to_string(list_sort(list_distinct(regexp_extract_all(left_over, '<([^>]+)>', 1))), ',') AS licenses,
  sentence_ids, n_sentences,
  len(regexp_extract_all(left_over, ',([0-9]+),', 1)) AS n_unruled
FROM ruled"""
