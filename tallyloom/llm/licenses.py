"""License scans by ordered signature rules, in DataFrame operations only.

Texts are lower-cased (A-Z) and reduced to words joined by single spaces. Each
rule is a regular expression over those words, tried only where its own keyword
and one of its license's names occur, which every match contains. A name alone counts
only if it holds a version number; others are often common words (``mit`` is German for
with), so they need the word license or terms beside them. Detections are word intervals. Of two, one
within the other, the one of lower priority goes, whichever is the longer; of equal
priority the outer one stays, of equal intervals the first by label. A sweep by (start,
longest first, priority) keeps those that are still open, so
``gnu lesser general public license version 3`` hides the ``general public license``
inside it. Everything happens within a row: no shuffle, no explode.

Defined results: a null or empty text has no words, no places, empty labels and score
0; first_word and last_word are null without a base place; repeated rows are scanned
alike; null doc_ids are carried through; columns other than those named are not read.
Whole texts are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase -> label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    names: tuple[str, ...] = (" ",)


#: label, how the license is named in running text (a regular expression over words), its SPDX words, and what occurs in any text that names it
NAMES = (
    ("mit", "(?:mit|expat|x11)", "mit", (" mit ", " expat ", " x11 ",)),
    ("mit-0", "mit no attribution", "mit 0", (" mit no ", " mit 0 ")),
    ("isc", "isc", "isc", (" isc ",)),
    ("apache-1.1", "apache(?: software)?(?: license)? (?:version |v)?1 1", "apache 1 1", (" apache ",)),
    ("apache-2", "apache(?: software)?(?: license)? (?:version |v)?2(?: 0)?", "apache 2 0", (" apache ",)),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause", ("bsd ",)),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd)", "bsd 3 clause", ("bsd ",)),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause", ("bsd ",)),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd", ("bsd ",)),
    ("gpl-2", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)?", "gpl 2 0", ("general public", " gpl",)),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)?", "gpl 3 0", ("general public", " gpl",)),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?2 1", "lgpl 2 1", ("lesser general", " lgpl",)),
    ("lgpl-3", "(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?3(?: 0)?", "lgpl 3 0", ("lesser general", " lgpl",)),
    ("agpl-3", "(?:gnu )?(?:affero general public license|agpl) ?(?:version |v)?3(?: 0)?", "agpl 3 0", ("affero", " agpl",)),
    ("gfdl", "(?:gnu )?free documentation", "gfdl 1 3", ("free documentation", " gfdl",)),
    ("mpl-1.1", "(?:mozilla public license|mpl) ?(?:version |v)?1 1", "mpl 1 1", ("mozilla", " mpl",)),
    ("mpl-2", "(?:mozilla public license|mpl) ?(?:version |v)?2(?: 0)?", "mpl 2 0", ("mozilla", " mpl",)),
    ("epl-1", "eclipse public(?: license)? ?(?:version |v)?1(?: 0)?", "epl 1 0", ("eclipse", " epl",)),
    ("epl-2", "eclipse public(?: license)? ?(?:version |v)?2(?: 0)?", "epl 2 0", ("eclipse", " epl",)),
    ("cddl-1", "common development and distribution", "cddl 1 0", ("common development", " cddl",)),
    ("cpl-1", "common public(?: license)? ?(?:version |v)?1(?: 0)?", "cpl 1 0", ("common public", " cpl",)),
    ("eupl-1.2", "(?:european union public|eupl)(?: licence| license)? ?(?:version |v)?1 2", "eupl 1 2", ("european union", " eupl",)),
    ("artistic-1", "artistic(?: license)? (?:version |v)?1(?: 0)?", "artistic 1 0", (" artistic",)),
    ("artistic-2", "artistic(?: license)? (?:version |v)?2(?: 0)?", "artistic 2 0", (" artistic",)),
    ("bsl-1", "boost software(?: license)?(?: version)?(?: 1 0)?", "bsl 1 0", (" boost ", " bsl",)),
    ("busl-1.1", "business source(?: license)?(?: 1 1)?", "busl 1 1", ("business source", " busl",)),
    ("sspl-1", "server side public(?: license)?", "sspl 1 0", ("server side", " sspl",)),
    ("elastic-2", "elastic(?: license)?(?: 2 0)?", "elastic 2 0", (" elastic ",)),
    ("cc0", "(?:cc0|cc 0|creative commons zero)(?: 1 0)?", "cc0 1 0", (" cc0 ", " cc 0 ", "creative commons zero",)),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1-4] [05])?", "cc by 4 0", (" cc by ", "creative commons",)),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by sa 4 0", (" cc by sa", "creative commons",)),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?", "cc by nd 4 0", (" cc by nd", "creative commons",)),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by nc 4 0", (" cc by nc", "creative commons",)),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by nc sa 4 0", (" cc by nc sa", "creative commons",)),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", "cc by nc nd 4 0", (" cc by nc nd", "creative commons",)),
    ("unlicense", "(?:the )?unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl", ("wtfpl", "the fuck",)),
    ("zlib", "(?:zlib|zlib libpng)", "zlib", (" zlib",)),
    ("libpng", "(?:libpng|png reference library)", "libpng", ("libpng", "png reference",)),
    ("python-2", "(?:python software foundation|psf)(?: license)?(?: version)?(?: 2)?", "psf 2 0", ("python software", " psf ",)),
    ("ruby", "ruby", "ruby", (" ruby ",)),
    ("php-3.01", "php(?: license)?(?: version)?(?: 3 01)?", "php 3 01", (" php ",)),
    ("ofl-1.1", "(?:sil )?open font(?: license)?(?: version)?(?: 1 1)?", "ofl 1 1", ("open font", " ofl ",)),
    ("odbl-1", "(?:open database|odbl)", "odbl 1 0", ("open database", " odbl",)),
    ("odc-by", "(?:open data commons attribution|odc by)", "odc by 1 0", ("open data commons", " odc ",)),
    ("pddl", "(?:public domain dedication and|pddl)", "pddl 1 0", ("domain dedication", " pddl",)),
    ("openssl", "openssl", "openssl", ("openssl",)),
    ("postgresql", "postgresql", "postgresql", ("postgresql",)),
    ("ncsa", "(?:ncsa|university of illinois)(?: open source)?", "ncsa", (" ncsa ", "university of illinois",)),
    ("ms-pl", "(?:microsoft public|ms pl)", "ms pl", ("microsoft public", " ms pl",)),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", "ms rl", ("microsoft reciprocal", " ms rl",)),
    ("osl-3", "open software(?: license)? ?(?:version |v)?3(?: 0)?", "osl 3 0", ("open software", " osl ",)),
    ("afl-3", "academic free(?: license)? ?(?:version |v)?3(?: 0)?", "afl 3 0", ("academic free", " afl ",)),
    ("cecill-2.1", "cecill", "cecill 2 1", ("cecill",)),
    ("upl-1", "universal permissive", "upl 1 0", ("universal permissive", " upl ",)),
    ("json", "json", "json", (" json ",)),
    ("curl", "curl", "curl", (" curl ",)),
    ("vim", "vim", "vim", (" vim ",)),
    ("ogl-uk-3", "open government(?: licence| license)?(?: v| version)?(?: ?3(?: 0)?)?", "ogl uk 3 0", ("open government", " ogl ",)),
    ("mulan-2", "mulan(?: permissive software)?", "mulanpsl 2 0", ("mulan",)),
)
#: How a license is declared: the keyword that must occur too, the pattern around its name ({n}) or SPDX words ({s}), priority, weight.
WAYS = (
    ("spdx", "spdx license identifier {s}(?: only| or later)?", 9, 1.0),
    ("licen", "licen[cs]ed under(?: the)?(?: terms of the)? {n}(?: licen[cs]e)?", 7, 0.95),
    ("licen", "(?:released|distributed|available|published|provided) under(?: the)?(?: terms of the)? {n} licen[cs]e", 6, 0.95),
    ("licen", "under(?: the)?(?: terms of the)? {n} licen[cs]e", 5, 0.9),
    ("licen", "licen[cs]e {n}", 3, 0.7),
    ("licen", "{n} licen[cs]e", 2, 0.6),
    (" ", "{n}", 3, 0.6),  # only of names that hold a version number
)
#: Licenses whose names, as patterns above, hold a version number for certain.
NUMBERED = frozenset(
    "apache-1.1 apache-2 gpl-2 gpl-3 lgpl-2.1 lgpl-3 agpl-3 mpl-1.1 mpl-2 epl-1 epl-2 cpl-1 eupl-1.2 artistic-1 artistic-2 osl-3 afl-3".split()
)
#: Signatures of a license's or notice's own wording.
TEXTS = (
    Rule("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 8, 1.0),
    Rule("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 8, 1.0),
    Rule("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 8, 0.9),
    Rule("bsd-3-clause", "neither the name", "neither the name of .{1,80}? nor the names of its contributors", 8, 1.0),
    Rule("apache-2", "apache org", "(?:https? )?(?:www )?apache org licenses license 2 0", 8, 1.0),
    Rule("apache-2", "apache license", "apache license version 2(?: 0)?", 8, 1.0),
    Rule("gpl", "free software foundation", "as published by the free software foundation", 6, 0.8),
    Rule("gpl", "general public license", "general public license", 1, 0.6),
    Rule("lgpl", "lesser general public", "lesser general public license", 2, 0.7),
    Rule("mpl-2", "mozilla", "subject to the terms of the mozilla public license v 2 0", 8, 1.0),
    Rule("zlib", "as is", "provided as is without any express or implied warranty in no event will the authors be held liable", 8, 1.0),
    Rule("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 8, 1.0),
    Rule("public-domain", "public domain", "(?:released into|in|placed in|dedicated to) the public domain", 4, 0.8),
    Rule("cc", "creativecommons", "creativecommons org licenses (?:by(?: nc)?(?: nd| sa)?)", 8, 1.0),
    Rule("cc0", "creativecommons", "creativecommons org publicdomain zero", 8, 1.0),
    Rule("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?", 4, 0.9),
    Rule("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?", 5, 0.9),
    Rule("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?", 5, 0.9),
    Rule("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", 4, 0.9),
    Rule("mit", "the software is provided as is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 7, 0.9),
    Rule("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 8, 1.0),
    Rule("mit-0", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 5, 0.7),
    Rule("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice", 7, 0.9),
    Rule("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 7, 0.9),
    Rule("bsd", "by the copyright holders and contributors", "this software is provided by the copyright holders and contributors as is", 7, 0.9),
    Rule("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 8, 1.0),
    Rule("isc", "provided that the above copyright notice", "with or without fee is hereby granted provided that the above copyright notice", 7, 0.9),
    Rule("apache-2", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 8, 1.0),
    Rule("apache-2", "except in compliance with the license", "you may not use this file except in compliance with the license", 7, 0.9),
    Rule("apache-1.1", "developed by the apache software foundation", "this product includes software developed by the apache software foundation", 8, 1.0),
    Rule("gpl", "you can redistribute it and or modify", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 8, 1.0),
    Rule("lgpl", "you can redistribute it and or modify", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 8, 1.0),
    Rule("gpl", "received a copy of the gnu general public", "you should have received a copy of the gnu general public license along with this program", 7, 0.9),
    Rule("lgpl", "received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this library", 7, 0.9),
    Rule("agpl-3", "gnu affero general public license as published", "gnu affero general public license as published by the free software foundation either version 3", 8, 1.0),
    Rule("gpl", "fitness for a particular purpose see the gnu", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser )?general public license", 7, 0.9),
    Rule("gpl-2", "version 2 of the license", "general public license as published by the free software foundation either version 2 of the license", 9, 1.0),
    Rule("gpl-3", "version 3 of the license", "general public license as published by the free software foundation either version 3 of the license", 9, 1.0),
    Rule("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 8, 1.0),
    Rule("mpl-2", "this source code form", "this source code form is subject to the terms of the mozilla public license", 9, 1.0),
    Rule("mpl-1.1", "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1", 9, 1.0),
    Rule("epl-1", "eclipse org legal epl v10", "(?:https? )?(?:www )?eclipse org legal epl v10", 8, 1.0),
    Rule("epl-2", "eclipse org legal epl", "(?:https? )?(?:www )?eclipse org legal epl (?:v20|2 0)", 8, 1.0),
    Rule("epl-2", "eclipse public license v 2", "made available under the terms of the eclipse public license v 2 0", 8, 1.0),
    Rule("cddl", "common development and distribution", "subject to the terms of the common development and distribution license", 8, 1.0),
    Rule("zlib", "origin of this software", "the origin of this software must not be misrepresented", 8, 1.0),
    Rule("zlib", "altered source versions", "altered source versions must be plainly marked as such", 8, 1.0),
    Rule("boost", "boost org license 1 0", "(?:https? )?(?:www )?boost org license 1 0", 8, 1.0),
    Rule("boost", "boost software license", "distributed under the boost software license version 1 0", 8, 1.0),
    Rule("wtfpl", "what the fuck you want", "do what the fuck you want to public license", 8, 1.0),
    Rule("unlicense", "anyone is free to copy modify", "anyone is free to copy modify publish use compile sell or distribute this software", 8, 1.0),
    Rule("cc0", "waived all copyright", "(?:has|have) waived all copyright and related or neighboring rights", 8, 1.0),
    Rule("cc0", "cc0 1 0 universal", "cc0 1 0 universal", 7, 1.0),
    Rule("cc-by", "creative commons attribution", "creative commons attribution(?: [1-4] [05])?(?: international)? licen[cs]e", 6, 0.9),
    Rule("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike(?: [1-4] [05])?(?: international)? licen[cs]e", 7, 0.9),
    Rule("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", 5, 0.9),
    Rule("ofl-1.1", "sil open font license", "this font software is licensed under the sil open font license version 1 1", 8, 1.0),
    Rule("ofl-1.1", "scripts sil org ofl", "scripts sil org ofl", 8, 1.0),
    Rule("python-2", "psf license agreement", "psf license agreement for python", 8, 1.0),
    Rule("php-3", "php net license 3", "(?:https? )?(?:www )?php net license 3 0(?: ?1)? txt", 8, 1.0),
    Rule("ms-pl", "microsoft public license", "subject to the microsoft public license", 8, 1.0),
    Rule("openssl", "openssl toolkit", "developed by the openssl project for use in the openssl toolkit", 8, 1.0),
    Rule("json", "not evil", "the software shall be used for good not evil", 8, 1.0),
    Rule("beerware", "buy me a beer", "you can buy me a beer in return", 8, 1.0),
    Rule("proprietary", "prior written permission", "(?:no part of this|may not be) .{0,60}?(?:reproduced|copied|distributed) .{0,80}?without (?:the )?(?:express )?prior written permission", 5, 0.7),
    Rule("proprietary", "trade secret", "(?:confidential|proprietary) (?:information )?(?:and|or) trade secrets?", 4, 0.7),
    Rule("proprietary", "end user license agreement", "end user license agreement", 3, 0.6),
    Rule("proprietary", "internal use only", "for internal use only", 3, 0.5),
    Rule("proprietary", "evaluation purposes only", "for evaluation purposes only", 3, 0.5),
    Rule("proprietary", "rights reserved", "all rights reserved", 1, 0.4),
    Rule("proprietary", "confidential", "proprietary and confidential", 4, 0.8),
    Rule("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 1, 0.3),
)


def rules() -> list[Rule]:
    """The signatures, in order of their priority."""
    made = [Rule(label, key, way.format(n=name, s=spdx), priority, weight, names) for label, name, spdx, names in NAMES for key, way, priority, weight in WAYS if way != "{n}" or label in NUMBERED]
    return sorted([*made, *TEXTS], key=lambda r: -r.priority)


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def _between(pattern: str) -> str:
    """The pattern where whole words match it."""
    return f"(?<= )(?:{pattern})(?= )"


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _labels(found: str) -> Column:
    return F.expr(f"array_join(array_sort(array_distinct({found})), ',')")


def scan(docs: DataFrame, signatures: list[Rule] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    signatures, base = rules() if signatures is None else signatures, BASE if base is None else base
    phrases = _between("|".join(base))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), GAP, " ")), F.lit(" "))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.select("doc_id", words.alias("w")).withColumn("n_words", F.expr(f"if(trim(w) = '', 0, {_spaces('w')} - 1)").cast("long"))
    out = out.withColumns({"pieces": F.split("w", phrases, -1), "places": F.expr(f"regexp_extract_all(w, {_quoted(phrases)}, 0)")})
    n_base = F.size("places")
    first = F.expr(f"{_spaces('pieces[0]')} - 1")
    last = F.expr(f"{_spaces('w')} - {_spaces('element_at(pieces, -1)')} - {_spaces('element_at(places, -1)')} - 1")
    out = out.withColumn("n_base", n_base.cast("long")).withColumns({"first_word": F.when(F.col("n_base") > 0, first.cast("long")), "last_word": F.when(F.col("n_base") > 0, last.cast("long"))})
    named = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    out = out.withColumn("base_found", F.when(F.col("n_base") > 0, F.transform(F.array_distinct("places"), lambda p: named[p])).otherwise(F.array().cast("array<string>")))
    # the names of a license are looked for once, then the keywords of its rules
    one = lambda r: F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(_between(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"))
    by_names: dict[tuple[str, ...], list[Rule]] = {}
    for r in signatures:
        by_names.setdefault(r.names, []).append(r)
    groups = F.array(*[F.struct(F.array(*map(F.lit, names)).alias("names"), F.array(*map(one, own)).alias("rules")) for names, own in by_names.items()])
    named = F.filter(groups, lambda g: F.exists(g["names"], lambda n: F.contains(F.col("w"), n)))
    tried = out.withColumn("active", F.flatten(F.transform(named, lambda g: F.filter(g["rules"], lambda r: F.contains(F.col("w"), r["keyword"])))))
    hits = f"""flatten(transform(active, r -> aggregate(
        arrays_zip(split(w, r.pattern, -1), regexp_extract_all(w, r.pattern, 0)),
        named_struct('at', -1, 'hits', cast(array() as array<struct<start: int, back: int, low: int, label: string, weight: double>>)),
        (s, x) -> if(x['1'] is null, s, named_struct(
            'at', s.at + {_spaces("x['0']")} + {_spaces("x['1']")},
            'hits', array_append(s.hits, named_struct('start', s.at + {_spaces("x['0']")}, 'back', -(s.at + {_spaces("x['0']")} + {_spaces("x['1']")}), 'low', -r.priority, 'label', r.label, 'weight', r.weight)))),
        s -> s.hits)))"""
    open_type = "struct<end: int, priority: int, label: string, weight: double, dead: boolean>"
    alive = lambda which: f"filter(s.open, o -> not o.dead{which})"
    taken = lambda which: f"""'labels', array_union(s.labels, transform({alive(which)}, o -> o.label)), 'score', greatest(s.score, coalesce(array_max(transform({alive(which)}, o -> o.weight)), 0.0D))"""
    swept = f"""aggregate(array_sort(hits),
        named_struct('open', cast(array() as array<{open_type}>), 'labels', cast(array() as array<string>), 'score', 0.0D),
        (s, h) -> named_struct('open', cast(array_append(
                transform(filter(s.open, o -> o.end >= h.start), o -> named_struct('end', o.end, 'priority', o.priority, 'label', o.label, 'weight', o.weight, 'dead', o.dead or (o.end >= -h.back and o.priority < -h.low))),
                named_struct('end', -h.back, 'priority', -h.low, 'label', h.label, 'weight', h.weight, 'dead', exists(s.open, o -> o.end >= -h.back and o.priority >= -h.low))) as array<{open_type}>),
            {taken(' and o.end < h.start')}),
        s -> named_struct({taken('')}))"""
    tried = tried.withColumn("hits", F.expr(hits)).withColumn("kept", F.expr(swept))
    more = F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("kept.score", F.lit(0.0)))
    return tried.withColumn("found", F.concat("base_found", more)).select("doc_id", "n_words", "n_base", "first_word", "last_word", _labels("base_found").alias("base_labels"), _labels("found").alias("labels"), score.alias("score"))
