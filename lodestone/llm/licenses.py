"""License scan: ordered signature rules, a keyword gate, priorities and containment.

A text is lower-cased (A-Z) and cut into words of a-z, 0-9 and characters beyond ASCII. Texts that
hold none of the gate words, as nearly all, are done. The others are written as one string in which
each word stands between its own two spaces, and every rule whose keyword is in that string runs its
pattern over it. Each place where a pattern matches is a detection with a span; a detection is
suppressed if its span lies within that of another one with an equal or better priority. What remains
gives the labels; the labels of the three base phrases always stay.

Rules are the passages, notices and addresses of TEXTS (priority 2) and, for each of LICENSES, the forms in which
it is named: an SPDX tag (1), a grant ("licensed under ...") (2), a pointer ("see the ... for details") (3) and the
bare name (4). Equal spans of equal priority go to the rule that stands first. The score is that of the best remaining form, 0.5 if only
a base phrase is there, 0 with no detection.

Null texts count as empty; texts of any length are scanned whole. Rows are judged one by one, so repeated rows get repeated results and an
empty table gives an empty one. Only the id and the text are read. All DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, count_words, table, written

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Not a-z, 0-9 or beyond ASCII, once in lower case; and the same for text whose A-Z stand for a-z.
CUT, CUT_ANY = r"\x00-\x2F\x3A-\x60\x7B-\x7F", r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

#: Label, keyword (a word of every form of the name), patterns of the name, SPDX id in words.
LICENSES = (
    ("0bsd", "bsd", "zero clause bsd(?: license)?|bsd zero clause(?: license)?", "0bsd"),
    ("afl-3.0", "academic", "academic free license(?: v(?:ersion)?)?(?: 3(?: 0)?)?", "afl 3 0"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: (?:version|v) ?3(?: 0)?)?", "agpl 3 0"),
    ("apache-1.1", "apache", "apache (?:software )?license(?: version)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("artistic-1.0", "artistic", "artistic license(?: version)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("blueoak-1.0.0", "oak", "blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?", "bsd 4 clause"),
    ("bsl-1.0", "boost", "boost software license(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-3.0", "cc", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cddl-1.0", "distribution", "common development and distribution license(?: version)?(?: 1(?: 0)?)?", "cddl 1 0"),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: license)?(?: agreement)?(?: v?2 1)?", "cecill 2 1"),
    ("creative-commons", "creative", "creative commons(?: attribution)?(?: non ?commercial)?(?: share ?alike)?(?: no ?derivatives)?(?: [1-4] 0)?(?: international)?(?: license)?", "cc"),
    ("ecl-2.0", "educational", "educational community license(?: version)?(?: 2 0)?", "ecl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)?(?: 1 0)", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)?(?: 2 0)", "epl 2 0"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: v?1 2)?", "eupl 1 2"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license(?: version)?(?: 1 3)?", "gfdl 1 3"),
    ("gpl-1.0", "general", "(?:gnu )?general public license (?:version |v ?)1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general", "(?:gnu )?general public license (?:version |v ?)2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general", "(?:gnu )?general public license (?:version |v ?)3(?: 0)?", "gpl 3 0"),
    ("isc", "isc", "isc license", "isc"),
    ("lgpl-2.1", "general", "(?:gnu )?(?:lesser|library) general public license(?: (?:version|v) ?2(?: 1)?)", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: (?:version|v) ?3(?: 0)?)", "lgpl 3 0"),
    ("lppl-1.3c", "latex", "latex project public license(?: 1 3c?)?", "lppl 1 3c"),
    ("mit", "mit", "mit license", "mit"),
    ("mit-0", "mit", "mit no attribution(?: license)?", "mit 0"),
    ("mit-expat", "expat", "expat license", "expat"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)?(?: 1 1)", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)?(?: 2 0)", "mpl 2 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa (?:open source )?license", "ncsa"),
    ("odbl-1.0", "database", "open (?:data commons open )?database license(?: v?1 0)?", "odbl 1 0"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("osl-3.0", "open", "open software license(?: version| v)?(?: 3 0)?", "osl 3 0"),
    ("php-3.01", "php", "php license(?: version)?(?: 3 01)?", "php 3 01"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("psf-2.0", "python", "python software foundation license(?: version)?(?: 2)?", "psf 2 0"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("upl-1.0", "permissive", "universal permissive license(?: v?1 0)?", "upl 1 0"),
    ("vim", "vim", "vim license", "vim"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?license", "w3c"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?", "wtfpl"),
    ("zlib", "zlib", "zlib license|zlib libpng license", "zlib"),
    ("zpl-2.1", "zope", "zope public license(?: v?2 1)?", "zpl 2 1"),
)
#: Label, keyword, a passage of the license's own text.
TEXTS = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "(?:released into|placed in|in|into) the public domain"),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution)(?: [^ ]+){0,6} (?:is )?(?:strictly )?prohibited"),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "opensource", "opensource org licenses? mit(?: license(?: php| html)?)?"),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", "opensource", "opensource org licenses? mit 0"),
    ("mit", "dual", "dual licensed under (?:the )?mit(?: and| or)"),
    ("isc", "opensource", "opensource org licenses? isc(?: license(?: txt)?)?"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "internet", "internet (?:systems|software) consortium license"),
    ("0bsd", "opensource", "opensource org licenses? 0bsd"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd(?: 2 clause| license(?: php)?)"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd-3-clause", "regents", "the regents of the university of california all rights reserved"),
    ("bsd-3-clause", "style", "bsd style license that can be found in the license file"),
    ("bsd-4-clause", "berkeley", "this product includes software developed by the university of california berkeley and its contributors"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation http www apache org"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "(?:www )?apache org licenses? license 2 0(?: txt| html)?"),
    ("apache-2.0", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "permissions", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "basis", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "opensource", "opensource org licenses? apache 2 0"),
    ("gpl-2.0", "general", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "general", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "gnu", "(?:www )?gnu org (?:old )?licenses? (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-3.0", "gnu", "(?:www )?gnu org licenses? gpl 3 0(?: html| txt)?"),
    ("gpl", "gnu", "(?:www )?gnu org (?:copyleft gpl html|licenses? gpl(?: html| txt)?)"),
    ("gpl-2.0", "opensource", "opensource org licenses? gpl 2 0"),
    ("gpl-3.0", "opensource", "opensource org licenses? gpl 3 0"),
    ("gpl", "general", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "hope", "this program is distributed in the hope that it will be useful but without any warranty(?= (?:[^ ]+ ){0,40}license)"),
    ("gpl-2.0", "franklin", "free software foundation inc 51 franklin (?:street|st) fifth floor boston ma 02110 1301(?: usa)?(?= (?:[^ ]+ ){0,60}license)"),
    ("gpl-1.0", "mass", "free software foundation inc 675 mass ave cambridge ma 02139(?: usa)?(?= (?:[^ ]+ ){0,60}license)"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "gnu", "(?:www )?gnu org (?:old )?licenses? (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("lgpl-3.0", "gnu", "(?:www )?gnu org licenses? lgpl 3 0(?: html| txt)?"),
    ("lgpl-2.0", "library", "gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl-3.0", "affero", "gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", "gnu", "(?:www )?gnu org licenses? agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl-3.0", "opensource", "opensource org licenses? agpl 3 0"),
    ("gfdl-1.3", "documentation", "copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.3", "gnu", "(?:www )?gnu org (?:licenses? fdl(?: 1 3)?|copyleft fdl)(?: html| txt)?"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla", "(?:www )?mozilla org mpl 2 0(?= (?:[^ ]+ ){0,40}license)"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "mozilla", "(?:www )?mozilla org mpl mpl 1 1 html(?= (?:[^ ]+ ){0,40}license)"),
    ("mpl-2.0", "opensource", "opensource org licenses? mpl 2 0"),
    ("epl-1.0", "eclipse", "(?:accompanying materials )?(?:are )?made available under the terms of the eclipse public license v 1 0"),
    ("epl-2.0", "eclipse", "(?:accompanying materials )?(?:are )?made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", "eclipse", "(?:www )?eclipse org legal epl v10 html(?= (?:[^ ]+ ){0,40}license)"),
    ("epl-2.0", "eclipse", "(?:www )?eclipse org legal epl 2 0(?= (?:[^ ]+ ){0,40}license)"),
    ("epl-1.0", "opensource", "opensource org licenses? epl 1 0"),
    ("cddl-1.0", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "opensource", "opensource org licenses? cddl 1 0"),
    ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "creativecommons", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-4.0", "creativecommons", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-3.0", "creativecommons", "creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "dedicated", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", "attribution", "creative commons attribution 4 0(?: international)?(?: public)? license"),
    ("cc-by-sa-4.0", "attribution", "creative commons attribution share ?alike 4 0(?: international)?(?: public)? license"),
    ("cc-by-nc-4.0", "attribution", "creative commons attribution non ?commercial 4 0(?: international)?(?: public)? license"),
    ("cc-by-3.0", "attribution", "creative commons attribution 3 0(?: unported)? license"),
    ("unlicense", "unlicense", "(?:please )?refer to http unlicense org"),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software(?= (?:[^ ]+ ){0,40}(?:domain|license))"),
    ("public-domain", "domain", "(?:dedicates?|dedicated) (?:this (?:work|software|file) )?to the public domain"),
    ("public-domain", "copyright", "the authors? disclaims? copyright to this source code"),
    ("wtfpl", "wtfpl", "(?:www )?wtfpl net(?: txt copying)?"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented(?= (?:[^ ]+ ){0,80}(?:license|authors))"),
    ("zlib", "altered", "altered source versions must be plainly marked as such(?= (?:[^ ]+ ){0,80}(?:license|authors))"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", "boost", "(?:www )?boost org license 1 0 txt"),
    ("ofl-1.1", "sil", "scripts sil org ofl(?= (?:[^ ]+ ){0,40}licens)"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("artistic-2.0", "artistic", "this package is free software you may redistribute it under the terms of the artistic license"),
    ("artistic-1.0", "perl", "(?:redistribute it and or modify it )?under the same terms as perl itself(?= (?:[^ ]+ ){0,40}licens)"),
    ("psf-2.0", "python", "python software foundation all rights reserved"),
    ("psf-2.0", "python", "psf license agreement for python"),
    ("php-3.01", "php", "(?:www )?php net license 3 01 txt"),
    ("postgresql", "postgresql", "postgresql global development group(?= (?:[^ ]+ ){0,60}(?:license|copyright))"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights(?= (?:[^ ]+ ){0,60}sublicense)"),
    ("openssl", "openssl", "this product includes software developed by the openssl project(?= (?:[^ ]+ ){0,60}(?:license|copyright))"),
    ("openssl", "openssl", "openssl (?:and ssleay )?licenses?"),
    ("curl", "curl", "curl license(?: agreement)?"),
    ("x11", "consortium", "x consortium shall not be used in advertising or otherwise to promote"),
    ("x11", "x11", "x11 license"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ms-pl", "microsoft", "microsoft public license ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license ms rl"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version 1 2)?"),
    ("cecill-2.1", "cecill", "governed by the cecill license under french law"),
    ("sspl-1.0", "server", "server side public license(?: version 1)?"),
    ("bsl-1.1", "business", "business source license(?: 1 1)?"),
    ("elastic-2.0", "elastic", "elastic license(?: 2 0)?"),
    ("commons-clause", "commons", "commons clause license condition"),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|small business|strict) license(?: 1 0 0)?"),
    ("fair", "usage", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("beerware", "beer", "beer ?ware license(?: revision 42)?"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("proprietary", "trade", "(?:contains|constitutes) (?:confidential information and )?trade secrets(?= (?:[^ ]+ ){0,60}(?:copyright|license|confidential))"),
    ("proprietary", "end", "end user license agreement"),
    ("proprietary", "licensed", "licensed for (?:evaluation|internal) (?:use|purposes) only"),
    ("proprietary", "permission", "without the (?:express |prior )?(?:express )?written permission of the copyright (?:holder|owner)"),
)
#: Form, priority, score, pattern around the name.
FORMS = (
    ("tag", 1, 1.0, "spdx license identifier {spdx}(?: only| or later)?"),
    ("grant", 2, 0.95, "(?:licensed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})"),
    ("pointer", 3, 0.8, "(?:see|read|consult) (?:the )?(?:{name})(?: file)?(?: for (?:more )?(?:details|information))?"),
    ("name", 4, 0.6, "(?:{name})"),
)
#: One of these is in every text on which a rule or a base phrase can match.
GATE = ("licen", "reserved", "copyright", "hereby", "domain", "permission", "redistribut", "neither", "advertising", "authors", "waived", "unencumbered", "confidential", "unauthorized", "wtfpl", "cc0", "cecill", "fuck", "creative", "clause", "attribution", "opensource", "fdl", "conditions", "eupl", "works is permitted", "good not evil", "good, not evil", "apache", "gnu", "sell copies", "substantial portions", "disclaim", "university of california", "mozilla", "eclipse", "publicdomain", "dedicat", "what the", "boost", "python", "consortium", "polyform")
#: The gate for names that begin with the word cc.
GATE_CC = rf"(?i)cc[{CUT_ANY}]+by"


def spaced(pattern: str) -> str:
    """A pattern over words for the string in which each word has its own two spaces."""
    return " " + pattern.replace("[^ ]", "\0").replace(" ", "  ").replace("\0", "[^ ]") + " "


def build_rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, score, keyword, pattern), in order."""
    rules = [(label, p, s, "spdx" if form == "tag" else keyword, spaced(around.format(name=name, spdx=spdx))) for form, p, s, around in FORMS for label, keyword, name, spdx in LICENSES]
    rules += [(label, 2, 0.9, keyword, spaced(text)) for label, keyword, text in TEXTS]
    return sorted(rules, key=lambda r: r[1])


RULES = build_rules()


def gate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in GATE]) | text.rlike(GATE_CC)


def detections(text: Column, rules=RULES) -> Column:
    """Array of struct(start, end, priority, number, label, score) over the spaced string."""
    # One expression with its own literal pattern per rule, so each is compiled once; only rules whose keyword is there run.
    found = [F.when(F.contains(text, F.lit(f" {keyword} ")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) for _, _, _, keyword, pattern in rules]
    every = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(r[0]).alias("label"), F.lit(r[1]).alias("priority"), F.lit(r[2]).alias("score"), f.alias("found")) for k, (r, f) in enumerate(zip(rules, found, strict=True))])
    hit = F.filter(every, lambda r: F.size(r["found"]) > 0)

    def places(rule: Column) -> Column:
        none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("priority"), F.lit(0).alias("number"), F.lit("").alias("label"), F.lit(0.0).alias("score"))), lambda x: F.lit(False))

        def step(acc: Column, m: Column) -> Column:
            at = F.call_function("locate", m, text, acc["next"])
            span = F.struct(at.alias("start"), (at + F.length(m)).alias("end"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label"), rule["score"].alias("score"))
            return F.struct((at + F.length(m)).alias("next"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(rule["found"], F.struct(F.lit(1).alias("next"), none.alias("spans")), step, lambda acc: acc["spans"])

    return F.flatten(F.transform(hit, places))


def remaining(spans: Column) -> Column:
    """struct(labels, score) of the detections whose span lies in none of equal or better priority before it.

    In the order of start, longest first, then priority and rule number, whatever contains a span
    stands before it; so the farthest end so far of each priority decides.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["number"].alias("number"), s["label"].alias("label"), s["score"].alias("score"))))
    zero = F.struct(*[F.lit(0).alias(f"e{p}") for p in (1, 2, 3, 4)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        hidden = reduce(lambda a, b: a | b, [(s["priority"] >= p) & (acc[f"e{p}"] >= end) for p in (1, 2, 3, 4)])
        ends = [F.when(~hidden & (s["priority"] == p), F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3, 4)]
        return F.struct(*ends, F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(s["label"]))).alias("labels"), F.when(hidden, acc["score"]).otherwise(F.greatest(acc["score"], s["score"])).alias("score"))

    return F.aggregate(order, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per input row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    spaced_text = F.concat(F.lit(" "), F.array_join(F.filter(F.split(ascii_lower(text), f"[{CUT}]+"), lambda w: w != ""), "  "), F.lit(" "))
    # Written, so that the words are cut once and each rule reads the finished string.
    rows = written(df.select(df[id_col].alias("id"), count_words(text, CUT_ANY).alias("n_words"), F.when(gate(text), spaced_text).alias("t")))
    words = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("bigint")
    cols = []
    for phrase, label in BASE:
        pieces = F.split("t", spaced(phrase))
        n = F.size(pieces) - 1
        cols.append(F.when(n > 0, F.struct(n.cast("bigint").alias("n"), words(pieces[0]).alias("first"), (F.col("n_words") - words(F.element_at(pieces, -1)) - len(phrase.split())).alias("last"), F.lit(label).alias("label"))))
    base = F.when(F.col("t").isNotNull(), F.filter(F.array(*cols), lambda x: x.isNotNull()))
    found = rows.select("id", "n_words", base.alias("base"), F.when(F.col("t").isNotNull(), detections(F.col("t"), rules)).alias("spans"))
    kept = found.select("id", "n_words", "base", F.when(F.size("spans") > 0, remaining(F.col("spans"))).alias("kept"))
    own = F.transform("base", lambda x: x["label"])
    joined = lambda x: F.coalesce(F.array_join(F.array_sort(F.array_distinct(x)), ","), F.lit(""))
    nothing = F.array().cast("array<string>")
    return kept.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(F.aggregate("base", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), F.lit(0)).alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(F.coalesce(own, nothing), F.coalesce("kept.labels", nothing))).alias("labels"),
        F.greatest(F.coalesce("kept.score", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
